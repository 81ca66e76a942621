"""The contract's queries over the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import bpe, exact_dedup, lm, metric_join, packing, quality, rolling, sharding, simhash, toxicity, url_filter, warc, whitening
from foliomill.llm.common import id_crc32, table

#: Fixed values of the URL contract.
HOST_PATH_RULES = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text.  Null and empty texts have no windows and get the score of a text without a hit; ids may be null (held out by the crc32 of the empty text) or repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (id_crc32("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url.  A null url or one without `://` has an empty host and path and fits no rule; equal urls get equal verdicts; the longest rule wins, and no two that fit a url are of one length."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fixed = [url_filter.host_path_rule(*r) for r in HOST_PATH_RULES]
    judged = url_filter.judge(pages, fixed + url_filter.DEFAULT_WORD_RULES)
    # `rule` names the host/path rules only; a verdict of the word rules is the method's.
    named = F.when(F.col("rule").isin([r.name for r in fixed]), F.col("rule"))
    return judged.select("page_id", "host", "path", named.alias("rule"), "verdict", F.when(named.isNull(), F.col("rule")).alias("word_rule"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts; the largest doc_id stays, null ids last.  Null counts as empty; of rows that tie in text and id one is kept; whole texts are compared, of any length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sorted_ = exact_dedup.content_sort(docs, keep="largest", carry=["doc_id"])
    return sorted_.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of near equal bytes.  Null text: size 8; records that share an id share a virtual slot; ties in the order inside a shard go by the text's crc32; an empty table gives no rows."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records written and read back.  Null html is an empty payload; a null page_id stays null; of equal payloads the smallest page_id is the response, and a payload may have any length."""
    index = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")  # noqa: E731  none: a null page_id
    return warc.read_records(index).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page(F.col("refers_to"))).alias("refers_to"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text.  Null and empty texts have no words and fail the base rules; rows are judged one by one, so repeated rows get equal verdicts."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base score and model score of every whole text.  Null texts are empty: one token, the end.  Repeated rows count each; texts of any length go through windows."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and their decoding, as digests.  Null texts are empty: no ids; a special token's string in a text becomes its id, as the library does."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of at most 2048 tokens.  Null texts are empty: one piece, the end id; repeated ids and equal texts are packed row by row; long texts are cut."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text.  Null, empty and blank texts have fingerprint zero and link like any other; repeated rows share a component; a null id is smallest only where there is no other."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_rolling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct and hot users of every kind and minute that holds a click.  Rows without ts or kind take no part; rows of one click_id are one click; clicks of a null client_id only make their minute appear; an empty table gives no rows."""
    return rolling.rolling_users(table(spark, sf_dir, "clicks"), {"users_short": 10, "users_middle": 60, "users_long": 720}, ("hot_users", 720, 5))


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every text.  Null, empty and blank texts have no shingles and link with nothing; fewer than five words are one shingle; equal texts and repeated ids share a component; a null id is smallest only where there is no other; an empty table gives no rows."""
    return metric_join.jaccard_components(table(spark, sf_dir, "documents"), shingle=5, least=0.8)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened vectors by component.  Vectors that are null or empty, or hold null or non-finite entries, give no rows; repeated ids and equal vectors count each; equal eigenvalues may come in any basis; an empty table gives no rows."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_url_filter, op3_exact_dedup, op4_sharding, op5_warc, op6_quality, op7_lm_scoring, op8_bpe, op9_packing, op10_simhash,
    op11_rolling_users, op12_metric_join, op13_whitening)}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS dg FROM pages),
        g AS (SELECT dg, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY dg)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.dg AS payload_digest,
               CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN g ON p.dg = g.dg""",
    # A click covers the minutes until the user's next one, the window's length at most; five clicks in a
    # row cover those from the fifth until the window leaves the first, or the sixth comes.
    "op11_rolling_users": """
        WITH rows_ AS (SELECT click_id, floor(epoch_us(ts) / 60000000.0)::BIGINT AS minute, kind, client_id FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL),
        c AS (SELECT minute, kind, client_id FROM rows_ WHERE click_id IS NULL
              UNION ALL
              SELECT minute, kind, client_id FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY minute, kind, client_id NULLS LAST) AS r
                                                   FROM rows_ WHERE click_id IS NOT NULL) WHERE r = 1),
        u AS (SELECT kind, client_id, minute, lead(minute) OVER w AS next, lag(minute, 4) OVER w AS fifth
              FROM c WHERE client_id IS NOT NULL WINDOW w AS (PARTITION BY kind, client_id ORDER BY minute)),
        spans AS (SELECT kind, minute AS a, least(minute + 10, coalesce(next, minute + 10)) AS b, 1 AS s, 0 AS m, 0 AS l, 0 AS h FROM u
                  UNION ALL SELECT kind, minute, least(minute + 60, coalesce(next, minute + 60)), 0, 1, 0, 0 FROM u
                  UNION ALL SELECT kind, minute, least(minute + 720, coalesce(next, minute + 720)), 0, 0, 1, 0 FROM u
                  UNION ALL SELECT kind, minute, least(fifth + 720, coalesce(next, fifth + 720)), 0, 0, 0, 1 FROM u WHERE fifth + 720 > minute),
        edges AS (SELECT kind, a AS minute, s, m, l, h, 0 AS here FROM spans WHERE a < b
                  UNION ALL SELECT kind, b, -s, -m, -l, -h, 0 FROM spans WHERE a < b
                  UNION ALL SELECT kind, minute, 0, 0, 0, 0, 1 FROM c),
        sums AS (SELECT kind, minute, sum(s) AS s, sum(m) AS m, sum(l) AS l, sum(h) AS h, sum(here) AS here FROM edges GROUP BY kind, minute),
        totals AS (SELECT kind, minute, here, sum(s) OVER w AS s, sum(m) OVER w AS m, sum(l) OVER w AS l, sum(h) OVER w AS h
                   FROM sums WINDOW w AS (PARTITION BY kind ORDER BY minute ROWS UNBOUNDED PRECEDING))
        SELECT kind, minute, s::BIGINT AS users_short, m::BIGINT AS users_middle, l::BIGINT AS users_long, h::BIGINT AS hot_users FROM totals WHERE here > 0""",
    "op12_metric_join": """
        WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS s FROM d),
        u AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
        e AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r
                           GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        c AS (SELECT r, r AS m FROM s UNION SELECT c.r, e.b FROM c JOIN e ON c.m = e.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id) AS component_id FROM s JOIN c ON s.r = c.r JOIN s t ON t.r = c.m GROUP BY s.r, s.doc_id, len(s.s)""",
}
