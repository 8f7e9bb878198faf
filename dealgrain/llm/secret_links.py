"""Secrets in texts, and weak credential parts that complement each other.

Strong finds (assignments to a secret name, access identifiers, long hexadecimal runs) are always reported. Weak parts
are other account identifiers, random-looking tokens and endpoints. A weak part counts only within a scope, some
characters around it, that holds what completes it: a token needs an identifier, an identifier needs a secret, and an
endpoint needs both, each of them outside the part itself. A token that overlaps an identifier is its value and no part. The interval join of parts and scopes is one sweep over the parts of a text in order of position, so
no pairs are formed. Everything is built from Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tables import pick

#: Characters between a weak part and what completes it, at most.
SCOPE = 200

GLUE = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Part:
    """A pattern; ``group`` holds the value, which must have ``least`` characters and match all of ``needs``."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    strong: bool = False
    needs: tuple[str, ...] = ()


PARTS = (
    Part("assign", r"(?i:(password|passwd|secret|token|api_?key))" + GLUE + r"([A-Za-z0-9+/_.=-]+)", 8, 2, True),
    Part("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    # A run of 32 is found exactly where the run of any length would be, and short runs need not be listed.
    Part("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Part("ident", r"(?i:(username|user|login|client_?id|access_?key_?id|account))" + GLUE + r"([A-Za-z0-9@._-]+)", 3, 2),
    Part("secret", r"[A-Za-z0-9+/_-]{20,}", 20, 0, False, ("[0-9]", "[a-z]", "[A-Z]")),
    Part("endpoint", r"https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 10),
)
KINDS = tuple(p.kind for p in PARTS)
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "secret")


def _matches(text: Column, number: int, part: Part) -> Column:
    """kind, gap before the match, size of the match and whether it is good, for every match of the pattern in order."""
    pattern = F.lit(part.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(part.group)) if part.group else hits
    gaps = F.split(text, part.pattern, -1)

    def describe(hit: Column, place: Column) -> Column:
        value = values[place] if part.group else hit
        good = F.length(value) >= part.least
        for need in part.needs:
            good = good & value.rlike(need)
        return F.struct(F.lit(number).alias("kind"), F.length(gaps[place]).cast("bigint").alias("gap"), F.length(hit).cast("bigint").alias("size"), good.alias("good"))

    return F.when(text.rlike(part.pattern), F.transform(hits, describe))


def _listed(*kinds: str) -> Column:
    return F.col("kind").isin([KINDS.index(k) for k in kinds])


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id and spans (start, kind number, end in code points with the end exclusive, strong), in order.

    Weak spans that touch a strong one are left to it. Null and empty texts have no spans; null ids and repeated rows keep
    their own rows; an empty table gives an empty result; other columns are ignored. Texts are read whole.
    """
    source = pick(df, doc_id=id_column, text=text_column)
    text = F.coalesce("text", F.lit(""))
    lists = [F.coalesce(_matches(text, i, p), F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,good:boolean>>")) for i, p in enumerate(PARTS)]
    found = materialise(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*lists).alias("matches")), "matches")
    some = F.exists("matches", lambda m: m["good"])
    parts = _placed(found.where(some).select("row", F.posexplode("matches").alias("place", "m")))
    span = F.struct("start", "kind", "end", "strong")
    # At most the parts of one text.
    listed = _completed(parts, scope).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = "array<struct<start:bigint,kind:int,end:bigint,strong:boolean>>"
    empty = F.array().cast(spans)
    with_parts = found.where(some).select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
    return with_parts.unionByName(found.where(~some).select("doc_id", empty.alias("spans")))


def _placed(matches: DataFrame) -> DataFrame:
    """Good matches with their places: gaps and matches of one pattern, added up from the start of the text."""
    before = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    flat = matches.select("row", "place", "m.*").repartition("row")
    ended = flat.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    strong = F.col("kind").isin([i for i, p in enumerate(PARTS) if p.strong])
    return ended.where("good").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", strong.alias("strong"))


def _own_values(parts: DataFrame) -> DataFrame:
    """Without random-looking tokens that overlap an identifier: these are the identifier's own value, not a secret beside it."""
    order = ("start", "kind", "end")
    ahead = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    over = F.max(F.when(_listed("ident"), F.col("end"))).over(ahead) > F.col("start")
    under = F.min(F.when(_listed("ident"), F.col("start"))).over(behind) < F.col("end")
    judged = parts.withColumn("own", F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False)))
    return judged.where(~(_listed("secret") & F.col("own"))).drop("own")


def _completed(parts: DataFrame, scope: int) -> DataFrame:
    """Strong parts, and weak ones that touch none of them and have in their scope what completes them.

    A part is completed only by parts that lie wholly before or behind it. Every part gives two events, its start and its end, and
    one sweep up and one down over the events tell the nearest part that ends before a start and that starts behind an end.
    """
    events = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("side")), F.struct(F.col("end").alias("at"), F.lit(0).alias("side"))))
    swept = _own_values(parts).select("*", events.alias("e")).select("row", "kind", "start", "end", "strong", "e.*")
    starts, ends = F.col("side") == 1, F.col("side") == 0
    # At one place ends come before starts going up, starts before ends going down.
    up = Window.partitionBy("row").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    strong = F.col("strong").cast("int")

    def before(*kinds: str) -> Column:
        return F.when(starts, F.max(F.when(ends & _listed(*kinds), F.col("at"))).over(up))

    def behind(*kinds: str) -> Column:
        return F.when(ends, F.min(F.when(starts & _listed(*kinds), F.col("at"))).over(down))

    marks = {"id_before": before(*IDENTIFIERS), "secret_before": before(*SECRETS), "id_behind": behind(*IDENTIFIERS), "secret_behind": behind(*SECRETS)}
    # Strong parts that began before the end, without those that ended by the start, overlap.
    marks |= {"begun": F.when(ends, F.sum(F.when(starts, strong).otherwise(0)).over(up)), "over": F.when(starts, F.sum(F.when(ends, strong).otherwise(0)).over(up))}
    told = swept.withColumns(marks).groupBy("row", "kind", "start", "end", "strong").agg(*[F.max(c).alias(c) for c in marks])

    def near(what: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{what}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"{what}_behind") - F.col("end") <= scope, F.lit(False))

    touched = F.coalesce(F.col("begun"), F.lit(0)) > F.coalesce(F.col("over"), F.lit(0))
    whole = F.when(_listed("secret"), near("id")).when(_listed("ident"), near("secret")).otherwise(near("id") & near("secret"))
    return told.where(F.col("strong") | (~touched & whole))


def span_text(spans: str, only_strong: bool = False) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(spans, lambda s: s["strong"]) if only_strong else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
