"""The operators applied to their whole tables, in the columns that the checks expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bagminhash, collocations, hidden, packing, pii, prefix_trie, quality, repeats, secret_links, suffixes, templates, toxicity
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .tables import id_remainder, read

PASSAGE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT s.r, i, hash(array_to_string(w[i:i + 49], ' ')) AS k FROM s JOIN d USING (r)),
g AS (SELECT k FROM h GROUP BY k HAVING count(DISTINCT r) > 1),
p AS (SELECT r, i - 1 AS a, i + 49 AS b FROM h JOIN g USING (k)),
o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY r ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM p),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY a) AS run FROM o),
m AS (SELECT r, min(a) AS a, max(b) AS b FROM n GROUP BY r, run)
SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS repeated_words, coalesce(string_agg(a || '-' || b, ',' ORDER BY a), '') AS spans
FROM d LEFT JOIN m USING (r) GROUP BY r, d.doc_id, d.w
"""


@query("op1_sparse_suffixes", PASSAGE_SQL)
def op1_sparse_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of every document that repeat in another one, as word ranges."""
    found = suffixes.repeated_passages(read(spark, folder, "documents"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "repeated_words", told.alias("spans"))


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to FROM k
"""


@query("op2_arc_to_warc", ARCHIVE_SQL)
def op2_arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as legacy archives of both versions, converted, and read back from the converted files."""
    arc = archives.write_arc(read(spark, folder, "pages"), versions=(1, 2))
    back = archives.read_warc_files(spark, archives.convert_archives(spark, arc))
    return back.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, w || chr(10) || lead(w, 1) OVER s || chr(10) || lead(w, 2) OVER s AS k FROM p WINDOW s AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g WHERE k IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + x) AS n FROM h, (VALUES (0), (1), (2)) AS v(x) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  coalesce(u.n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_ex
  FROM w LEFT JOIN c USING (r) LEFT JOIN u USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_upper > 50 * (n_upper + n_lower)
    OR 100 * n_ex > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars > 20 * n_words) AS kept
FROM m
"""


@query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of the cascade next to the base measures of every document."""
    told = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = quality.quality_verdicts(read(spark, folder, "documents"), report=told)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *told, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def _joined(spans: str, only: str | None = None) -> Column:
    """kind:start:end of all spans, or of the strict ones, joined by commas."""
    chosen = F.filter(spans, lambda s: s[only]) if only else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _strict_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")


def _secret_sql() -> str:
    """The same parts and the same sweep in plain SQL, from the same patterns."""
    lists = []
    for number, part in enumerate(secret_links.PARTS):
        pattern = part.pattern.replace("'", "''")
        needs = "".join(f" AND regexp_matches(v, '{need}')" for need in part.needs)
        lists.append(
            f"SELECT r, {number} AS k, i, length(g) AS gap, length(h) AS size, length(v) >= {part.least}{needs} AS good FROM ("
            f"SELECT r, unnest(regexp_extract_all(t, '{pattern}', 0)) AS h, unnest(regexp_extract_all(t, '{pattern}', {part.group})) AS v, "
            f"unnest(regexp_split_to_array(t, '{pattern}')) AS g, generate_subscripts(regexp_split_to_array(t, '{pattern}'), 1) AS i FROM d) WHERE h IS NOT NULL"
        )
    names = "['" + "', '".join(secret_links.KINDS) + "']"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(lists)}),
p AS (SELECT r, k, good, sum(gap + size) OVER (PARTITION BY r, k ORDER BY i) - size AS a, sum(gap + size) OVER (PARTITION BY r, k ORDER BY i) AS b FROM m),
q0 AS (SELECT r, k, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, k < 3 AS strong FROM p WHERE good),
q AS (SELECT * FROM q0 WHERE k <> 4 OR NOT EXISTS (SELECT 1 FROM q0 o WHERE o.r = q0.r AND o.k = 3 AND o.a < q0.b AND o.b > q0.a)),
n AS (SELECT *, EXISTS (SELECT 1 FROM q o WHERE o.r = q.r AND o.strong AND o.a < q.b AND o.b > q.a AND NOT q.strong) AS touched,
  EXISTS (SELECT 1 FROM q o WHERE o.r = q.r AND o.k IN (1, 3) AND (o.b <= q.a OR o.a >= q.b) AND q.a - o.b <= {secret_links.SCOPE} AND o.a - q.b <= {secret_links.SCOPE}) AS with_id,
  EXISTS (SELECT 1 FROM q o WHERE o.r = q.r AND o.k IN (0, 2, 4) AND (o.b <= q.a OR o.a >= q.b) AND q.a - o.b <= {secret_links.SCOPE} AND o.a - q.b <= {secret_links.SCOPE}) AS with_secret FROM q),
s AS (SELECT r, k, a, b, strong, {names}[k + 1] || ':' || a || ':' || b AS x FROM n
  WHERE strong OR NOT touched AND CASE k WHEN 4 THEN with_id WHEN 3 THEN with_secret ELSE with_id AND with_secret END)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY a, k) FILTER (strong), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY r, d.doc_id
"""


@query("op4_credential_links", _secret_sql())
def op4_credential_links(spark: SparkSession, folder: str) -> DataFrame:
    """Strong secrets and completed weak parts in every document."""
    found = secret_links.find_secrets(read(spark, folder, "documents"))

    def strong(number: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{kind}")

    counts = [strong(i, kind) for i, kind in enumerate(secret_links.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_links.span_text("spans", True), 256).alias("base_sha256"), secret_links.span_text("spans").alias("spans"))


@query("op5_template_leaks")
def op5_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of benchmark items found in documents, also with other numbers, names or units."""
    found = templates.template_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "class_items", "matched_tokens", "item_tokens", "slots", "changed_slots", "evidence", "leaked")


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Strict finds and the additions of the boosted trees in every document."""
    found = pii.find_personal_data(read(spark, folder, "documents"))
    counts = [_strict_count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("spans", "strict"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query("op7_hidden_markov")
def op7_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of every document under a model of nine tenths of them."""
    docs = read(spark, folder, "documents")
    learns = id_remainder("doc_id", 10) != 0
    found = hidden.score_texts(docs, hidden.train(docs.where(learns)), learns)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity score of every document, learned from three quarters of the labels."""
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    scorer = toxicity.train(docs, labels.where(id_remainder("doc_id", 4) != 2))
    held = (id_remainder("doc_id", 4) == 2).alias("held_out")
    return toxicity.score_toxicity(docs, scorer).select("doc_id", held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM d),
g AS (SELECT r, k, count(*) AS c FROM s GROUP BY r, k),
n AS (SELECT r, sum(c) AS n FROM g GROUP BY r),
i AS (SELECT x.r AS a, y.r AS b, sum(least(x.c, y.c)) AS c FROM g x JOIN g y USING (k) WHERE x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM i JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 5 * c >= 4 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(r, o) AS (SELECT r, r FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.o)
SELECT d.doc_id, min(o.doc_id) AS class_id, d.doc_id = min(o.doc_id) AS kept FROM t JOIN d USING (r) JOIN d o ON o.r = t.o GROUP BY d.r, d.doc_id
"""


@query("op9_bagminhash", NEAR_SQL)
def op9_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of its near-duplicates."""
    found = bagminhash.near_duplicate_classes(read(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "kept")


@query("op10_power_of_two_packing")
def op10_power_of_two_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut into pieces of binary lengths, one piece per sequence."""
    return packing.pack_documents(read(spark, folder, "documents"), added_as_text=False)


TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS h FROM t GROUP BY c),
b AS (SELECT s.c, s.h, least(s.h, coalesce(o.n, 0)) AS lead FROM s LEFT JOIN s o ON o.c = s.c - s.c % 100),
r AS (SELECT t.c, lead + i - h AS pos, role, txt FROM t JOIN b USING (c) WHERE i >= h
  UNION ALL SELECT b.c, i, role, txt FROM b JOIN t ON t.c = b.c - b.c % 100 AND i < h),
m AS (SELECT c, pos + 1 AS d, string_agg(length(role) || ':' || role || length(txt) || ':' || txt, '') OVER (PARTITION BY c ORDER BY pos) AS k, length(txt) AS chars FROM r
  UNION ALL SELECT c, 0, '', 0 FROM s),
z AS (SELECT c, max(d) AS d FROM m GROUP BY c),
e AS (SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM m JOIN z USING (c, d) GROUP BY d, k),
g AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved FROM m GROUP BY d, k),
u AS (SELECT g.d, g.k, g.saved, m.d AS ad, m.k AS ak FROM g JOIN m ON m.c = g.conv_id AND m.d <= g.d),
n AS (SELECT ad AS d, ak AS k, count(*) AS n FROM u WHERE ad = d - 1 GROUP BY ad, ak),
f AS (SELECT ad AS d, ak AS k, sum(CASE WHEN n.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM u LEFT JOIN n USING (d, k) GROUP BY ad, ak)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, g.n_convs, coalesce(n.n, 0) AS n_children, CAST(f.leaves AS BIGINT) AS n_leaves,
  CAST(f.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM g JOIN f USING (d, k) LEFT JOIN n USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN u ON u.d = g.d AND u.k = g.k AND u.ad = g.d - 1
LEFT JOIN g o ON o.d = u.ad AND o.k = u.ak
"""


@query("op11_euler_tour", TRIE_SQL)
def op11_euler_tour(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations with its subtree's figures."""
    return prefix_trie.conversation_trie(read(spark, folder, "conversations"))


REPEAT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT s.r, i, sha1(array_to_string(w[i:i + 34], ' ')) AS k FROM s JOIN d USING (r)),
g AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + x AS j FROM h JOIN g USING (k), range(0, 35) AS v(x)),
a AS (SELECT r, list(j) AS gone FROM c GROUP BY r),
o AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, w, coalesce(gone, []) AS gone FROM d LEFT JOIN a USING (r)),
p AS (SELECT doc_id, n_words, n_removed, list_filter(w, lambda x, i: NOT list_contains(gone, i)) AS kept FROM o)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM p
"""


@query("op13_seed_and_extend", REPEAT_SQL)
def op13_seed_and_extend(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that start anywhere else as well."""
    found = repeats.remove_repeats(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT c.*, j, array_to_string(s[:j], ' ') AS head, array_to_string(s[j + 1:], ' ') AS tail FROM c, (VALUES (1), (2)) AS v(j) WHERE j < k),
y AS (SELECT x.lang, x.phrase, x.a, j, h.f AS l, t.f AS r, 1000000 * a * a // (h.f * t.f) AS score
  FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head AND h.k = j JOIN f t ON t.lang = x.lang AND t.phrase = x.tail AND t.k = x.k - j),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT z.* FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = z.lang AND c.k = 3 AND 100 * c.a >= 50 * z.a
  AND (z.phrase = c.s[1] || ' ' || c.s[2] OR z.phrase = c.s[2] || ' ' || c.s[3])))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op12_rollup_collocations", COLLOCATION_SQL)
def op12_rollup_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return collocations.collocations(read(spark, folder, "documents"))
