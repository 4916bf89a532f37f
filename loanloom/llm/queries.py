"""The registered queries of this package and the SQL that some of them must equal."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import (
    bagminhash, decontaminate, exact, katz, language, licences, packing, phrases, prefixes, shards,
    substrings, suffixes, toxicity)

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; Python workers of a session started elsewhere learn where this package is."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


@query()
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


_OP2 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS b FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM t)),
bytes AS (SELECT doc_id, 1000 * k + o AS p, substr(b, 2 * o + 1, 2) AS x, substr(b, 2 * o + 1, 100) AS s
          FROM (SELECT *, unnest(range(0, least(1000, len(b) // 2))) AS o FROM blocks)),
starts AS (SELECT doc_id, p, s FROM bytes WHERE len(s) = 100),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
gone AS (SELECT doc_id, p FROM starts JOIN firsts USING (s) WHERE doc_id > first),
marked AS (SELECT b.doc_id, b.p, b.x, max(g.p) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
           IS NOT NULL AS removed FROM bytes b LEFT JOIN gone g USING (doc_id, p)),
edges AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked),
counted AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_spans FROM edges GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS h FROM marked WHERE NOT removed GROUP BY doc_id)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM t LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query(_OP2)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, folder, "documents"))
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_OP3 = r"""
WITH words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i
               FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (SELECT doc_id, i, word, list(word) OVER here AS following
            FROM words WINDOW here AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
hashed AS (SELECT doc_id, i, word, CASE WHEN len(following) = 35 THEN sha256(array_to_string(following, ' ')) END AS h FROM windows),
times AS (SELECT h, count(*) AS n FROM hashed WHERE h IS NOT NULL GROUP BY h),
marked AS (SELECT doc_id, i, word, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (
             PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM hashed LEFT JOIN times USING (h)),
counted AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
                   string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted USING (doc_id)
"""


@query(_OP3)
def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP4 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha256(norm) AS text_sha256
FROM t WINDOW best AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""


@query(_OP4)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.decisions(table(spark, folder, "documents"))


@query()
def op5_training_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.write_shards(table(spark, folder, "documents"), stable=True)[0]


@query()
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op7_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents"))


@query()
def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_copies(table(spark, folder, "documents"))


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select(
        "doc_id", toxicity.severity(F.col("toxic"), F.col("quality")).alias("grade"))
    graded = docs.select("doc_id", "text").join(labels, "doc_id")
    return toxicity.predict(docs, toxicity.fit(graded))


@query()
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    learned = docs.where(~language.held_out(F.col("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), language.fit(learned))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB, bit by bit."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: "
            f"list_reduce(range(0, 8), lambda x, i: {step}, xor(crc, b)), 4294967295::BIGINT), 4294967295)")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _discount(level: int, least: int) -> str:
    return f"CASE WHEN c < {least} THEN 0 WHEN c <= 5 THEN (SELECT d FROM discounts WHERE level = {level})[c] ELSE 1 END"


_OP11 = rf"""
WITH texts AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} % 10 = 0 AS held_out,
                      list_append(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), '') AS w FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(w) AS z, unnest(range(1, len(w) + 1)) AS i FROM texts),
grams AS (SELECT *, lag(z) OVER o AS y, lag(z, 2) OVER o AS x FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT z, count(*) AS c FROM grams WHERE NOT held_out GROUP BY z),
c2 AS (SELECT y, z, count(*) AS c FROM grams WHERE NOT held_out AND y IS NOT NULL GROUP BY ALL),
c3 AS (SELECT x, y, z, count(*) AS c FROM grams WHERE NOT held_out AND x IS NOT NULL GROUP BY ALL),
of_counts AS (SELECT level, list_transform(range(1, 7), lambda r: len(list_filter(list(c), lambda v: v = r))::DOUBLE) AS n
              FROM (SELECT 1 AS level, c FROM c1 UNION ALL SELECT 2, c FROM c2 UNION ALL SELECT 3, c FROM c3) u GROUP BY level),
tries AS (SELECT level, n, most, (most + 1) * n[most + 1] / n[1] AS q FROM of_counts, (SELECT unnest(range(1, 6)) AS most) m
          WHERE list_min(n[1:most + 1]) > 0),
good AS (SELECT level, most, list_transform(range(1, 6), lambda r: CASE WHEN r > most THEN 1
           ELSE ((r + 1) * n[r + 1] / (r * n[r]) - q) / (1 - q) END) AS d FROM tries WHERE q < 1),
fits AS (SELECT level, max_by(d, most) AS d FROM good
         WHERE list_min(d[1:most]) > 0 AND list_max(d[1:most]) < 1 GROUP BY level),
plain AS (SELECT level, CASE WHEN n[1] > 0 AND n[2] > 0 THEN n[1] / (n[1] + 2 * n[2]) ELSE 0.5 END AS less FROM of_counts),
discounts AS (SELECT level, coalesce(d, list_transform(range(1, 6), lambda r: (r - less) / r)) AS d FROM plain LEFT JOIN fits USING (level)),
sums AS (SELECT sum(c)::BIGINT AS n, count(*) AS v, 1 - sum({_discount(1, 1)} * c) / (sum(c) + 0.01) AS unknown FROM c1),
p1 AS (SELECT z, c, {_discount(1, 1)} * c / (n + 0.01) AS p FROM c1, sums),
p2 AS (SELECT c2.y, c2.z, c2.c, {_discount(2, 1).replace("c <", "c2.c <").replace("[c]", "[c2.c]")} * c2.c / (h.c + 0.01) AS p
       FROM c2 JOIN c1 h ON h.z = c2.y),
a2 AS (SELECT y, (1 - sum(p2.p)) / (1 - sum(p1.p)) AS a FROM p2 JOIN p1 USING (z) GROUP BY y),
p3 AS (SELECT c3.x, c3.y, c3.z, {_discount(3, 2).replace("c <", "c3.c <").replace("[c]", "[c3.c]")} * c3.c / (h.c + 0.01) AS p
       FROM c3 JOIN c2 h ON h.y = c3.x AND h.z = c3.y WHERE c3.c > 1),
a3 AS (SELECT x, y, (1 - sum(p3.p)) / (1 - sum(p2.p)) AS a FROM p3 JOIN p2 USING (y, z) GROUP BY x, y),
scored AS (SELECT doc_id, held_out, coalesce(p1.c, 0) AS c,
             coalesce(p3.p, coalesce(a3.a, 1) * coalesce(p2.p, coalesce(a2.a, 1) * coalesce(p1.p, unknown))) AS p
           FROM grams g CROSS JOIN sums LEFT JOIN p1 ON p1.z = g.z LEFT JOIN p2 ON p2.y = g.y AND p2.z = g.z LEFT JOIN a2 ON a2.y = g.y
           LEFT JOIN p3 ON p3.x = g.x AND p3.y = g.y AND p3.z = g.z LEFT JOIN a3 ON a3.x = g.x AND a3.y = g.y)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(coalesce(n, 0)) AS train_tokens,
       round(sum(log10((c + 0.1) / (n + 0.1 * (v + 1)))), 6) AS base_score, round(sum(log10(p)), 6) AS score
FROM scored, sums GROUP BY doc_id, held_out
"""


@query(_OP11)
def op11_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Scores to six digits, so that the order of additions doesn't show."""
    scores = katz.fit(table(spark, folder, "documents")).score()
    return scores.withColumns({name: F.round(name, 6) for name in ("base_score", "score")})


_OP12 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs, (SELECT unnest([1, 2, 3]) AS k) s WHERE len(w) >= k) x),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
inside AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM candidates WHERE k = 3),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (
           SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= 50 * c.a)),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, cut, l.n AS l, r.n AS r,
             ((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n))::BIGINT AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
           JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst JOIN words USING (lang) QUALIFY rank <= 2000
"""


@query(_OP12)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents"))


_OP13 = rf"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {_crc("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns) x),
parts AS (SELECT i.conv_id, 0 AS part, p, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 20 WHERE p <= h
          UNION ALL SELECT i.conv_id, 1, p, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id WHERE p > h),
deep AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth, sha256(len(role) || ':' || role || text) AS turn,
                len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM parts),
paths AS (SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM deep
          UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
whole AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
                 sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM whole GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, left(path, 64 * (depth - 1)::INT) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
tops AS (SELECT n.*, coalesce(n_children, 0) AS n_children, unnest(range(0, depth + 1)) AS top FROM nodes n LEFT JOIN children USING (depth, path)),
below AS (SELECT top AS depth, left(path, 64 * top::INT) AS path, count(*) FILTER (n_children = 0) AS n_leaves,
                 sum((n - 1) * words)::BIGINT AS saved_tokens FROM tops GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       n.ends_sha256
FROM nodes n JOIN below USING (depth, path) LEFT JOIN children USING (depth, path)
LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.path = left(n.path, 64 * (n.depth - 1)::INT)
"""


@query(_OP13)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.rebuilt_trie(table(spark, folder, "conversations"))
