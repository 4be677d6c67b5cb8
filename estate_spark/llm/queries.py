"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.llm import byte_bpe, collocations, decontamination, jaccard, language_id, license_scan, nearest, periodic_runs, token_counts, token_files, toxicity, url_filter, warc
from estate_spark.session import computed_once, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on shared storage for what one query writes."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.where(fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def toxicity_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict[str, DataFrame]:
    """Texts of the folds that may be learned from, and labels by ``doc_id``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return {"labelled": docs.select("doc_id", "text").where(fold("doc_id", 3) != 1), "labels": labels}


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, **toxicity_labels(spark, docs, sf_dir), label="label")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read_archives(manifest)


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def url_filter_sql() -> str:
    """Each rule tried on each url; the longest that fits wins."""
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    tried = " ".join(
        f"WHEN {fits.format(h=r.host, p=r.path)} THEN '{r.text}'" for r in sorted(URL_RULES, key=lambda r: -len(r.text))
    )
    blocked = ", ".join(f"'{r.text}'" for r in URL_RULES if r.action == "block")
    return f"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), judged AS (SELECT page_id, host, path, CASE {tried} END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' ELSE 'allow' END AS verdict FROM judged
    """


ORACLES["op8_url_filter"] = url_filter_sql()


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with benchmark text, one row for each item found; clean documents have none."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"),
        scratch(spark, "tokens"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        end_id=0,
    )
    return token_files.read_token_files(manifest, digest_only=True)


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("detections", lambda d: d.kind == 0))
    named = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda d: d.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        named("base").alias("base_labels"),
        named("detections").alias("labels"),
        "score",
    )


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def collocations_sql() -> str:
    """All phrases counted outright, then the same cuts, fragments and ranks."""
    numbered = " UNION ALL ".join(
        f"SELECT lang, array_to_string(words[i:i + {k - 1}], ' ') AS phrase, {k} AS size FROM (SELECT lang, words, unnest(range(1, len(words) - {k - 2})) AS i FROM pieces)"
        for k in range(1, collocations.LONGEST + 1)
    )
    return f"""
        WITH cut AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL
        ), pieces AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM cut
        ), counts AS MATERIALIZED (
            SELECT lang, phrase, size, count(*) AS f FROM ({numbered}) GROUP BY ALL
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
        ), candidates AS MATERIALIZED (
            SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= {collocations.LEAST}
        ), within AS (
            SELECT lang, a AS holder, unnest(flatten([[array_to_string(words[i:i + s - 1], ' ') FOR i IN range(1, size - s + 2)] FOR s IN range(2, size)])) AS phrase
            FROM candidates WHERE size > 2
        ), kept AS (
            SELECT * FROM candidates c WHERE NOT EXISTS (
                SELECT 1 FROM within w WHERE w.lang = c.lang AND w.phrase = c.phrase AND 100 * CAST(w.holder AS HUGEINT) >= {collocations.COVER} * CAST(c.a AS HUGEINT))
        ), sides AS (
            SELECT *, unnest(range(1, size)) AS k FROM kept
        ), scored AS (
            SELECT s.lang, s.phrase, s.a, s.k, x.f AS l, y.f AS r, CAST({collocations.SCALE}::HUGEINT * s.a // (x.f + y.f) AS BIGINT) AS score
            FROM sides s
            JOIN counts x ON x.lang = s.lang AND x.phrase = array_to_string(s.words[1:s.k], ' ')
            JOIN counts y ON y.lang = s.lang AND y.phrase = array_to_string(s.words[s.k + 1:], ' ')
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
    """


ORACLES["op12_collocations"] = collocations_sql()


def repeated_tails(docs: DataFrame) -> DataFrame:
    """Texts in which one id in ten repeats a stretch from some word on to the end; a null id counts as none of these."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    listed = computed_once(docs.select("doc_id", "text"), "words", F.when(h % 10 == 0, words))
    n = F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", a + 1, p), times))
    repeated = F.slice(F.concat(F.slice("words", 1, a), tail), 1, n)
    return listed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(repeated_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length, (-r.start).alias("before"), (-r.period).alias("fast"))))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    judged = found.withColumn("best", best)
    return judged.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.fast")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.fast")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
