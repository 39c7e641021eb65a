"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; only queries use this default, operators take the path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digests, write_token_files

    path = shared_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_digests(spark, path)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the hash of what they decode to."""
    from pyspark.sql import functions as F

    from .pieces import encode

    encoded = encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), decoded=True)
    return encoded.select("doc_id", "ids", "n_tokens", F.sha2("text", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, archived

    path = shared_dir(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    return archived(spark, path)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compared_with_edits

    return compared_with_edits(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii

    return pii(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of domains: a labelled document's language and quality."""
    from pyspark.sql import functions as F

    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(lang, "doc_id").select("doc_id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix, rates

    return rates(table(spark, sf_dir, "documents"), domains(spark, sf_dir), mix=Mix(min_rate=0.0))


def op7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op7_mixing`` has aimed at and reached."""
    from .mixing import Mix, totals

    return totals(table(spark, sf_dir, "documents"), domains(spark, sf_dir), mix=Mix(min_rate=0.0))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import clustered, with_inertia

    return with_inertia(*clustered(table(spark, sf_dir, "embeddings"))).drop("scans")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .packing import packed

    rows = packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_neighbours": op4_neighbours,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op7_totals": op7_totals,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_counts": op10_token_counts,
    "op11_clustering": op11_clustering,
    "op12_packing": op12_packing,
    "op13_spelling": op13_spelling,
}


def _clustering_sql(rounds: int = 3) -> str:
    """Plain rounds: all distances of all vectors, nearest by (distance, number), means by rounding down."""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v AS w
  FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT 16))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(m ORDER BY i) AS w FROM (
  SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


#: Checksums byte by byte over a table made by the published rule; near words meet on the word with one letter masked or left out.
SPELLING_SQL = """WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents) GROUP BY ALL),
hashed AS (SELECT word, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) AS h FROM runs, crc),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS masked, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.less = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.less = w.word),
best AS (SELECT a, count(*) AS n_near, min((-n, b)) AS top FROM near GROUP BY a),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top[1] >= 5 * words.n THEN top[2] END AS form, CASE WHEN -top[1] >= 5 * words.n THEN -top[1] END AS form_n
  FROM words LEFT JOIN best ON a = words.word),
led AS (SELECT word, word AS at FROM forms UNION ALL SELECT led.word, forms.form FROM led JOIN forms ON forms.word = led.at WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, led.at AS root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN led USING (word) JOIN forms g ON g.word = led.at AND g.form IS NULL"""

ORACLE_SQL: dict[str, str] = {"op11_clustering": _clustering_sql(), "op13_spelling": SPELLING_SQL}
