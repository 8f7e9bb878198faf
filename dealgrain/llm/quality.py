"""Quality rules as a short-circuit cascade.

Every rule is a predicate over one text. Each rule's cost and rejection rate are measured on a bounded
sample, rules are ordered by rejections per second, and a text meets a rule only if all earlier ones
let it pass. The order changes the cost and the name of the first rejecting rule, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded_sample, fresh, pick
from .textio import BLANKS, Words, byte_set, group_sums, pieces, text_bytes

#: Rows of the sample that orders the rules; it decides nothing else.
SAMPLE_ROWS = 1000
#: UTF-8 bytes of the sample at most (whole texts, the first alone may be larger).
SAMPLE_BYTES = 8 << 20

SYMBOLS = byte_set(b"#*$%&|<>")
BLANK_BYTES = b" \t\x0b\x0c\r"


class Measures:
    """Measures of a batch of texts, each worked out when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self._known: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def keep(self, mask: np.ndarray) -> Measures:
        """The measures of some of the texts; what is known stays known."""
        kept = Measures(self.texts.filter(pa.array(mask)))
        kept._known = {k: v[mask] for k, v in self._known.items() if k not in ("words", "bytes")}
        return kept

    def _bytes(self):
        return text_bytes(self.texts)

    def _words(self):
        return Words(self.texts)

    def _per_text(self, table: np.ndarray) -> np.ndarray:
        data, offsets = self["bytes"]
        return group_sums(table[data], offsets)

    def _n_words(self) -> np.ndarray:
        return self["words"].count.astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        heads = np.arange(256)
        return self._per_text(((heads & 0xC0) != 0x80) & ~BLANKS)

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(SYMBOLS)

    def _n_exclamations(self) -> np.ndarray:
        return self._per_text(byte_set(b"!"))

    def _n_upper(self) -> np.ndarray:
        return self._per_text(byte_set(bytes(range(65, 91))))

    def _n_lower(self) -> np.ndarray:
        return self._per_text(byte_set(bytes(range(97, 123))))

    def _lines(self) -> np.ndarray:
        """Per text: lines with a word, and those equal to an earlier line."""
        out = np.zeros((len(self), 2), dtype=np.int64)
        data, offsets = self["bytes"]
        raw = data.tobytes()
        for i in range(len(self)):
            lines = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(BLANK_BYTES)]
            out[i] = len(lines), len(lines) - len(set(lines))
        return out

    def _n_lines(self) -> np.ndarray:
        return self["lines"][:, 0]

    def _n_dup_lines(self) -> np.ndarray:
        return self["lines"][:, 1]

    def _n_repeat_words(self) -> np.ndarray:
        """Words inside a window of three words that occurs twice or more in the text."""
        words = self["words"]
        at, key = words.windows(3)
        # The text is part of the key, so that equal windows of two texts stay apart.
        again = pd.Series(key ^ (words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated(keep=False).to_numpy()
        covered = np.zeros(len(words.start), bool)
        for shift in range(3):
            covered[at[again] + shift] = True
        return group_sums(covered, words.first)


@dataclass(frozen=True)
class Rule:
    """``rejects`` says which texts the rule throws out."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


def few_words(least: int = 50) -> Rule:
    return Rule("few_words", lambda m: m["n_words"] < least)


def repeated_windows(percent: int = 50) -> Rule:
    return Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > percent * m["n_words"])


def symbol_words(percent: int = 10) -> Rule:
    return Rule("symbol_words", lambda m: 100 * m["n_symbols"] > percent * m["n_words"])


def shouting(percent: int = 50) -> Rule:
    return Rule("shouting", lambda m: 100 * m["n_upper"] > percent * (m["n_upper"] + m["n_lower"]))


def exclamations(percent: int = 20) -> Rule:
    return Rule("exclamations", lambda m: 100 * m["n_exclamations"] > percent * m["n_words"])


def repeated_lines(percent: int = 30) -> Rule:
    return Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > percent * m["n_lines"])


def long_words(most: int = 20) -> Rule:
    return Rule("long_words", lambda m: m["word_chars"] > most * m["n_words"])


def default_rules() -> list[Rule]:
    return [few_words(), repeated_windows(), symbol_words(), shouting(), exclamations(), repeated_lines(), long_words()]


def order_rules(sample: pa.Array, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Rules with their cost (seconds per text) and rejection rate on the sample, best first.

    The score is rejections per second; equal scores keep the given order. An empty sample keeps it too.
    """
    if not len(sample):
        return [(rule, 0.0, 0.0) for rule in rules]
    found = []
    for rule in rules:
        measures = Measures(sample)
        began = time.process_time()
        rejected = rule.rejects(measures)
        cost = max(time.process_time() - began, 1e-9) / len(sample)
        found.append((rule, cost, float(np.mean(rejected))))
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(measures: Measures, rules: list[Rule]) -> np.ndarray:
    """Index of the first rule that rejects each text, or -1."""
    verdict = np.full(len(measures), -1)
    left = np.arange(len(measures))
    for i, rule in enumerate(rules):
        if not len(left):
            break
        out = np.asarray(rule.rejects(measures), bool)
        verdict[left[out]] = i
        if out.any():
            left, measures = left[~out], measures.keep(~out)
    return verdict


def rule_sample(df: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> pa.Array:
    """About ``rows`` whole texts, picked by a hash, of at most ``size`` bytes in all.

    Texts of over eight times the mean share are left out of it, which bounds what the driver receives.
    """
    some = bounded_sample(df, rows, 7).where(F.octet_length("text") <= 8 * size // rows)
    found = some.toArrow().column("text").combine_chunks()
    _, offsets = text_bytes(found)
    return found.slice(0, max(1, int(np.searchsorted(offsets, size, side="right")) - 1)) if len(found) else found


def quality_verdicts(
    df: DataFrame,
    rules: list[Rule] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    report: tuple[str, ...] = (),
    keep_columns: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, the measures named in ``report``, kept and rejected_by.

    Null text counts as empty and is rejected by ``few_words``; null ids and repeated rows keep their own
    rows; an empty table gives an empty result; other columns are ignored, or passed on with
    ``keep_columns`` (then a name in use gets underscores before it).
    """
    rules = default_rules() if rules is None else rules
    texts = pick(df, doc_id=id_column, text=text_column)
    ordered = [rule for rule, _, _ in order_rules(rule_sample(texts), rules)]
    names = pa.array([rule.name for rule in ordered] + [None], pa.string())
    source = df if keep_columns else pick(df, doc_id=id_column, text=text_column)
    column = text_column if keep_columns else "text"
    fields = [f"`{c}` {t}" for c, t in source.dtypes if keep_columns or c != "text"]
    added = [fresh(source, name) if keep_columns else name for name in (*report, "kept", "rejected_by")]
    schema = ", ".join([*fields, *[f"`{name}` bigint" for name in added[:-2]], f"`{added[-2]}` boolean, `{added[-1]}` string"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            measures = Measures(piece.column(column))
            told = [pa.array(measures[name], pa.int64()) for name in report]
            verdict = cascade(measures, ordered)
            by = names.take(pa.array(np.where(verdict < 0, len(ordered), verdict)))
            passed = [piece.column(c) for c in piece.schema.names if keep_columns or c != "text"]
            labels = [c for c in piece.schema.names if keep_columns or c != "text"] + added
            yield pa.RecordBatch.from_arrays([*passed, *told, pa.array(verdict < 0), by], names=labels)

    return source.mapInArrow(judge, schema)


def quality_filter(df: DataFrame, rules: list[Rule] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that pass every rule, with all their columns."""
    judged = quality_verdicts(df, rules, id_column, text_column, keep_columns=True)
    return judged.where(F.col(f"`{fresh(df, 'kept')}`")).select(*[F.col(f"`{c}`") for c in df.columns])
