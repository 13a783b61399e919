"""The queries of the numbered operators and of the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wanderloop.config import ship_package
from wanderloop.llm.bpe import decode, encode, load_spec
from wanderloop.llm.cross_polytope import nearest
from wanderloop.llm.disclosure import KINDS, count_kind, find_personal_data, spans_text, terms_text
from wanderloop.llm.extraction import extract, fit_extractor
from wanderloop.llm.fingerprints import near_duplicates
from wanderloop.llm.lm import lm_scores
from wanderloop.llm.merkle import fold, lowered, manifest, proof_digest
from wanderloop.llm.merkle_sql import MERKLE_SQL
from wanderloop.llm.mixing import mix
from wanderloop.llm.pii_sql import PII_SQL
from wanderloop.llm.quality import fit_quality_tables, fit_quality_trees, quality_rules, quality_scores
from wanderloop.llm.repeats import remove_repeats
from wanderloop.llm.shared import bounded_batches, settle, text_of, word_count
from wanderloop.llm.url_lists import filter_urls, host_of, path_of
from wanderloop.llm.whitening import whiten

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            bounded_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_of(part: int, *columns: str) -> Column:
    """A number below 2^28 from seven digits of the md5 of the columns; ``part`` tells which digits."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary")), 1 + 7 * part, 7)
    return F.conv(digits, 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries drawn from the pages' own URLs: list, pattern, action and day by hash."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    labels = F.split(host, r"\.")
    kind, action = number_of(0, "url", "page_id") % 4, number_of(1, "url", "page_id") % 5
    first = F.concat(host, F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)), F.lit("/"))
    return pages.select(
        F.element_at(F.array(F.lit("malware"), F.lit("adult"), F.lit("spam")), (number_of(2, "url", "page_id") % 3 + 1).cast("int")).alias("list_name"),
        F.when(kind < 2, "host").when(kind == 2, "prefix").otherwise("url").alias("kind"),
        F.when(kind == 0, host).when(kind == 1, F.array_join(F.slice(labels, -2, 2), ".")).when(kind == 2, first)
        .otherwise(F.concat(host, path)).alias("pattern"),
        F.when(action < 2, "block").when(action == 2, "allow").otherwise("remove").alias("action"),
        F.date_add(F.lit("2023-01-01").cast("date"), (number_of(3, "url", "page_id") % 730).cast("int")).alias("day"),
    )


@query(
    "op1_url_filters",
    """WITH base AS (
         SELECT page_id, url, md5(concat_ws('|', url, CAST(page_id AS VARCHAR))) AS h,
                lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
                DATE '2023-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 7) AS BIGINT) % 730 AS INTEGER) AS day
         FROM pages),
       drawn AS (
         SELECT host, path, CAST('0x' || substr(h, 1, 7) AS BIGINT) % 4 AS kind, CAST('0x' || substr(h, 8, 7) AS BIGINT) % 5 AS action,
                CAST('0x' || substr(h, 15, 7) AS BIGINT) % 3 AS list, CAST('0x' || substr(h, 22, 7) AS BIGINT) % 730 AS day FROM base),
       entries AS (
         SELECT CASE list WHEN 0 THEN 'malware' WHEN 1 THEN 'adult' ELSE 'spam' END AS list_name,
                CASE WHEN kind < 2 THEN 'host' WHEN kind = 2 THEN 'prefix' ELSE 'url' END AS kind,
                CASE kind WHEN 0 THEN host WHEN 1 THEN array_to_string(string_split(host, '.')[-2:], '.')
                          WHEN 2 THEN host || '/' || split_part(path, '/', 2) || '/' ELSE host || path END AS pattern,
                CASE WHEN action < 2 THEN 2 WHEN action = 2 THEN 1 ELSE 0 END AS rank,
                DATE '2023-01-01' + CAST(day AS INTEGER) AS day FROM drawn),
       daily AS (SELECT list_name, kind, pattern, day, max(rank) AS rank FROM entries GROUP BY ALL),
       spans AS (SELECT *, lead(day) OVER (PARTITION BY list_name, kind, pattern ORDER BY day) AS until FROM daily),
       moments AS (SELECT DISTINCT url, day, host, path, string_split(host, '.') AS labels, string_split(path, '/') AS steps FROM base),
       asked AS (
         SELECT url, day, 'host' AS kind, 1 AS grade, unnest(list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.'))) AS pattern FROM moments
         UNION SELECT url, day, 'prefix', 2, unnest(list_transform(range(1, len(steps)), lambda i: host || array_to_string(steps[1:i], '/') || '/')) FROM moments
         UNION SELECT url, day, 'url', 3, host || path FROM moments),
       met AS (
         SELECT a.url, a.day, a.grade, a.pattern, s.list_name, s.rank FROM asked a JOIN spans s
         ON a.kind = s.kind AND a.pattern = s.pattern AND s.day <= a.day AND (s.until IS NULL OR a.day < s.until) WHERE s.rank > 0),
       decided AS (
         SELECT url, day, count(*) AS n_active, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists,
                arg_max(pattern, (grade, length(pattern), 2 - rank, pattern, list_name)) AS decided_by,
                arg_max(rank, (grade, length(pattern), 2 - rank, pattern, list_name)) = 2 AS blocked
         FROM met GROUP BY url, day)
       SELECT b.page_id, b.url, b.day, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists,
              coalesce(decided_by, '') AS decided_by, coalesce(blocked, false) AS blocked
       FROM base b LEFT JOIN decided d ON b.url = d.url AND b.day = d.day""",
)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day drawn from its id, against entries drawn from all URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2023-01-01").cast("date"), (number_of(0, "page_id") % 730).cast("int")))
    return filter_urls(captures, dated_entries(pages))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the boosted trees for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality_trees(docs, table(spark, sf_dir, "labels")))


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and attention-model log probabilities of every document, and of the letters of its unknown words."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), spell_path=ranks)


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive-model quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality_tables(docs, table(spark, sf_dir, "labels")))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    spec = load_spec(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, spec).drop("text")
    digests = coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
    )
    return decode(digests, spec).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, beside its source's size and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(text_of("text")).alias("size"))
    mixed, known = mix(settle(docs, "mix-sizes"), F.col("size"), F.array("source"))
    sources = spark.createDataFrame([(s, *known[s]) for s in known], "source string, source_size long, target double")
    # One row per source, bounded as the sets of sources are.
    return mixed.join(F.broadcast(sources), mixed["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


@query("op8_nearest")
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit_extractor(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_pii", PII_SQL)
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"),
        spans_text(F.col("all_spans")).alias("spans"), terms_text(F.col("terms")).alias("term_actions"),
    )


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding on the 32 strongest components."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op12_substring_dedup",
    """WITH docs AS (
         SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
       starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
       windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
       twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
       hit AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM windows SEMI JOIN twice USING (s))),
       words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs),
       kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN hit USING (r, j) GROUP BY r),
       gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r)
       SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
       FROM docs LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeated passages are gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, of_kept={"kept_sha256": F.sha2("kept", 256)})


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and where a tampered copy of it leads."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest(docs, changed={"text": tampered}).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.col("seen"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
