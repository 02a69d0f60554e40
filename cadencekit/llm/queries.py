"""Registered queries of the training-data operators, over whole tables, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadencekit.checks.base import table
from cadencekit.llm import (
    chat, fingerprints, language, merkle, mixing, neighbours, packing, secret_scan, simhash, spelling, suffix_array, suffix_tree, toxicity,
)
from cadencekit.llm.common import held_out


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.fingerprints(docs, fingerprints.lexicon(docs))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.train(docs))
    base = F.filter("_spans", lambda s: s["kind"] < 3)
    number = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secret_scan.digest(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.digest(F.col("_spans")).alias("spans"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 4, 2)
    scored = toxicity.score(docs, toxicity.train(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    found = language.identify(docs.select("doc_id", "text"), language.train(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = docs.select("doc_id", F.explode(spelling.letter_runs(F.col("text"))).alias("run"))
    runs = runs.select("doc_id", spelling.lowered(F.col("run")).alias("run"))
    # One run in 97 loses a letter, so that there are variants.
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.vocabulary(words))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Tampering only changes a count of characters that is there.
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    claimed = F.when(touched, merkle.leaf(*map(F.col, ("doc_id", "source", "lang")), F.col("n_chars") + 1, F.col("text")))
    leaf = merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    proofs = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), leaf, {"claimed": claimed})
    checked = merkle.folded(proofs.withColumn("claimed", F.coalesce("claimed", "leaf")), "claimed")
    shown = lambda name: F.lower(F.hex(name))
    return checked.select(
        F.col("key").alias("doc_id"), shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        F.sha2(shown("proof").cast("binary"), 256).alias("proof_sha256"), shown("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    both = talks.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], talks.schema))
    return chat.digests(chat.windows(both))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_imatch, op2_nearest, op3_simhash, op4_suffix_dedup, op5_mixing, op6_secrets,
                            op7_suffix_tree, op8_packing, op9_toxicity, op10_language, op11_spelling, op12_merkle, op13_chat)}

ORACLE_SQL: dict[str, str] = {"op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(text) AS digest,
         row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS nth
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap,
             CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
-- What all sources take together when the level just fills this one.
f AS (SELECT a.source, a.source_size, a.cap, a.weight,
             (SELECT sum(least(b.cap, b.weight * a.cap / a.weight)) FROM w b) AS filled FROM w a),
l AS (SELECT CAST(sum(source_size) - coalesce(sum(cap) FILTER (WHERE filled <= (SELECT sum(source_size) FROM w)), 0) AS DOUBLE)
             / sum(weight) FILTER (WHERE NOT filled <= (SELECT sum(source_size) FROM w)) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * coalesce(level, 0)) AS target FROM f, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(digest, '') || ':' || nth), 1, 8) AS BIGINT)
                               / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
""",
"op11_spelling": r"""
WITH RECURSIVE
-- CRC-32 by its polynomial, over the bytes of id and run.
tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
spelt AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM spelt, tab),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, times FROM hashed),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
p AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM v)),
ins AS (SELECT DISTINCT v.word AS short, p.word AS long FROM p JOIN v ON v.word = p.a || p.b),
near AS (
  SELECT x.word, y.word AS other FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT short, long FROM ins UNION ALL SELECT long, short FROM ins),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS other, max(v.n) AS other_n
  FROM near JOIN v ON v.word = near.other GROUP BY near.word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
         CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, here, next) AS (
  SELECT word, word, form FROM f
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL
""",
"op12_merkle": r"""
WITH RECURSIVE
-- CRC-32 by its polynomial, over the digits of the id.
tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
docs AS (
  SELECT row_number() OVER () AS row, d.*,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS crc
  FROM documents d, tab),
spelt AS (
  SELECT *, CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS claim,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body FROM docs),
leaves AS (
  SELECT row, doc_id, lang, crc, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
         sha256(head || coalesce(strlen(CAST(claim AS VARCHAR)) || ':' || claim, '-') || body) AS claimed
  FROM spelt),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS index, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
low(tree, level, index, n, digest) AS (
  SELECT tree, 0, index, n, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, index // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY index)) FROM low WHERE n > 1 GROUP BY ALL),
sub AS (SELECT tree, digest AS subroot, count(*) OVER () AS trees FROM low WHERE n = 1),
high(level, index, n, digest) AS (
  SELECT 0, tree, trees, subroot FROM sub
  UNION ALL
  SELECT level + 1, index // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY index)) FROM high WHERE n > 1 GROUP BY ALL),
-- One row for each level on a leaf's way: its sibling there, or none.
steps AS (
  SELECT p.row, l.level AS step, p.index >> l.level AS place, s.digest
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) l USING (tree)
  LEFT JOIN low s ON s.tree = p.tree AND s.level = l.level AND s.index = xor(p.index >> l.level, 1)
  UNION ALL
  SELECT p.row, 1000 + l.level, p.tree >> l.level, s.digest
  FROM placed p CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) l
  LEFT JOIN high s ON s.level = l.level AND s.index = xor(p.tree >> l.level, 1)),
ways AS (SELECT row, list({'side': place, 'd': digest} ORDER BY step) AS way, string_agg(digest, '' ORDER BY step) AS proof FROM steps GROUP BY row),
fold(row, way, i, digest) AS (
  SELECT p.row, coalesce(w.way, []), 1, claimed FROM placed p LEFT JOIN ways w USING (row)
  UNION ALL
  SELECT row, way, i + 1, sha256(CASE WHEN way[i].d IS NULL THEN digest WHEN way[i].side % 2 = 1 THEN way[i].d || digest ELSE digest || way[i].d END)
  FROM fold WHERE i <= len(way))
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(coalesce(w.proof, '')) AS proof_sha256, f.digest AS folded_root,
       f.digest = r.digest AS verified
FROM placed p JOIN sub s USING (tree) CROSS JOIN (SELECT digest FROM high WHERE n = 1) r LEFT JOIN ways w ON w.row = p.row
JOIN (SELECT row, digest FROM fold WHERE i = len(way) + 1) f ON f.row = p.row
""",
"op13_chat": r"""
WITH talks AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
spelt AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '### ' || replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': '
           || replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' AS shown FROM talks),
t AS (
  SELECT *, len(shown) + 1 AS chars, len(regexp_extract_all(shown, '[^\x20\x09-\x0D]+')) AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS index FROM spelt),
s AS (SELECT conv_id, max(tokens) FILTER (index = 0 AND role = 'system') AS sys, max(chars) FILTER (index = 0 AND role = 'system') AS sys_chars FROM t GROUP BY conv_id),
r AS (
  SELECT t.*, coalesce(sys, 0) AS sys, coalesce(sys_chars, 0) AS sys_chars, greatest(384 - coalesce(sys, 0), 1) AS room,
         index = 0 AND sys IS NOT NULL AS led,
         greatest(CAST(sum(tokens) OVER (PARTITION BY t.conv_id ORDER BY index) AS BIGINT) - tokens - coalesce(sys, 0), 0) AS start
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
c AS (SELECT *, start // room AS cell, (start + tokens - 1) // room = start // room AS whole FROM r WHERE NOT led),
g AS (SELECT conv_id, cell, bool_and(whole) OR bool_and(NOT whole) OR sum(tokens) <= any_value(room) AS one FROM c GROUP BY conv_id, cell),
w AS (SELECT c.conv_id, c.cell, CASE WHEN one OR whole THEN 0 ELSE 1 END AS number, min(start) AS start, any_value(sys_chars) AS sys_chars, count(*) AS n
      FROM c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id AND c.cell = g.cell GROUP BY ALL),
-- What windows repeat: the system turn, and the turns shortly before.
again AS (
  SELECT w.conv_id, sum(c.chars) AS chars FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.start < w.start AND w.start - c.start <= 128 AND c.cell >= w.cell - 1
  GROUP BY w.conv_id),
opened AS (SELECT conv_id, count(*) AS n_windows, sum(sys_chars) FILTER (cell > 0 OR number > 0) AS chars FROM w GROUP BY conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY index)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY index) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(t.chars) + coalesce(any_value(again.chars), 0) + coalesce(any_value(opened.chars), 0) AS BIGINT) AS formatted_chars,
       coalesce(any_value(n_windows), 1) AS n_windows
FROM t LEFT JOIN again ON again.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN opened ON opened.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY t.conv_id
"""}
