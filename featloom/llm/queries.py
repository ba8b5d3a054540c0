"""The registered queries of the text operators, with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import (bpe, bytes_dedup, decontaminate, exact_dedup, jaccard, language, line_dedup, phrases, secret_scan, spelling,
                          suffix_tree, surrogates, toxicity)
from featloom.llm.common import sha256, table
from featloom.plans.registry import query

EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d"""


@query("op2_exact_dedup", EXACT_DEDUP_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op10_language", tested_by="tests/llm/test_text_ops.py::test_language_held_out_accuracy")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn(docs.where(~language.held_out()))
    return language.predict(docs, profiles, carry=["doc_id"]).withColumn("held_out", language.held_out()).select(
        "doc_id", "held_out", "lang_pred", "score")


@query("op6_bpe", tested_by="tests/llm/test_text_ops.py::test_fragments_encode_as_the_whole")
def op6(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    words = bpe.Vocabulary(public_tokenizers.path(vocabulary))
    ids = bpe.encode(table(spark, sf_dir, "documents"), words, carry=["doc_id"])
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                      sha256(bpe.decode(F.col("ids"), words, spark)).alias("decoded_sha256"))


DECONTAMINATE_SQL = r"""
WITH low AS (SELECT 'item' AS kind, CAST(item_id AS VARCHAR) AS id, text FROM benchmark
             UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), text FROM documents),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
item AS (SELECT id, ws, least(len(ws), 13) AS n FROM w WHERE kind = 'item' AND len(ws) > 0),
win AS (SELECT DISTINCT id, n, array_to_string(ws[s:s + n - 1], ' ') AS g
        FROM (SELECT id, n, ws, unnest(range(1, len(ws) - n + 2)) AS s FROM item)),
doc AS (SELECT CAST(id AS BIGINT) AS doc_id, ws FROM w WHERE kind = 'doc'),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS s
             FROM doc JOIN (SELECT DISTINCT n FROM win) ON len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, n, s, id FROM dw JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha
        FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op9_decontaminate", DECONTAMINATE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        sha256(F.array_join("items", ",")).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


@query("op3_secrets", tested_by="tests/llm/test_text_ops.py::test_secrets_base_spans_against_brute_force")
def op3(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    found = secret_scan.find(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN,
                         carry=["doc_id"])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS],
        sha256(F.array_join(F.transform(of(*secret_scan.KINDS[:3]), name), ",")).alias("base_sha256"),
        F.array_join(F.transform("secrets", name), ",").alias("spans"))


TOXIC_CATEGORIES = ["low_quality", "toxic"]


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    """Fitted on the given documents and labels; the labels have two categories to chain."""
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels, TOXIC_CATEGORIES)


@query("op4_toxicity", tested_by="tests/llm/test_text_ops.py::test_toxicity_held_out")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.predict(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir), carry=["doc_id"])
    return scores.withColumn("toxic", F.col("p_toxic") >= 0.5)


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, pos, line, often.key IS NOT NULL AND k.doc_id <> top AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


@query("op5_line_dedup", LINE_DEDUP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


@query("op1_surrogates", tested_by="tests/llm/test_text_ops.py::test_surrogates_of_names_domains_and_accounts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.featloom.surrogates.key", "set one of your own")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, key)


@query("op8_jaccard", tested_by="tests/llm/test_dedup_ops.py::test_jaccard_against_brute_force")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_suffix_dedup", tested_by="tests/llm/test_dedup_ops.py::test_bytes_dedup_against_brute_force")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytes_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, g, count(*) AS a FROM
        (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS g
         FROM w, range(1, 6) AS t(m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT lang, g[1:m - 1] AS g, a FROM f WHERE m > 2 UNION ALL SELECT lang, g[2:m], a FROM f WHERE m > 2),
above AS (SELECT lang, g, max(a) AS above FROM inner_ GROUP BY ALL),
cand AS (SELECT f.* FROM f LEFT JOIN above USING (lang, g) WHERE m > 1 AND (above IS NULL OR 100 * above < 100 * a)),
cut AS (SELECT lang, m, g, a, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
           FROM cut c JOIN f x ON x.lang = c.lang AND x.m = k AND x.g = c.g[1:k]
           JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.g = c.g[k + 1:c.m] JOIN total t ON t.lang = c.lang),
weakest AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000"""


@query("op11_phrases", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_suffix_tree", tested_by="tests/llm/test_corpus_ops.py::test_scores_as_brute_force")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    found = suffix_tree.score(table(spark, sf_dir, "documents"), learn)
    return found.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


SPELLING_SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
run AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM low) GROUP BY ALL),
-- crc32, a byte at a time: the table's entry for a byte takes eight shifts.
steps AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
hashed AS (SELECT run, k, length(run) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM run),
crc AS (SELECT run, k, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
               lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) AS h FROM hashed, steps),
words AS (SELECT word, sum(k)::BIGINT AS n FROM
            (SELECT k, CASE WHEN h % 199 = 0 THEN run[1:h % n] || run[h % n + 2:n] ELSE run END AS word FROM crc)
          WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, i, word[1:i - 1] || word[i + 1:length(word)] AS rest, length(word) AS len
         FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.len = b.len AND a.word <> b.word
         UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
         UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT near.word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near JOIN words o ON o.word = other GROUP BY near.word),
form AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n
         FROM words LEFT JOIN best USING (word)),
lead AS (SELECT word, word AS at FROM form UNION ALL SELECT lead.word, f.form FROM lead JOIN form f ON f.word = lead.at AND f.form IS NOT NULL)
SELECT f.word, f.form, l.at AS root, f.n, f.n_near, f.form_n
FROM form f JOIN lead l ON l.word = f.word JOIN form g ON g.word = l.at AND g.form IS NULL"""


@query("op13_spelling", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))
