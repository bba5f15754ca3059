"""The queries of this subpackage: ``QUERIES`` by name, and ``ORACLE_SQL`` where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, byte_bpe, chat, codes, jaccard, licenses, neighbours, packing, quality, repair, substrings, topk, urls
from .common import read_table

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query among all embeddings."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates the template's own marks, formatted and read back."""
    planted = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_conversations(chat.in_order(chat.render_turns(turns)))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 3-word shingles with a similarity of 0.9."""
    return jaccard.linked(read_table(spark, sf_dir, "documents"), 3, 90)


def op4_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps, with their weights."""
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of every document placed in a sequence."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded and decoded."""
    return bpe.digest_texts(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions of every whole document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 13 words that a smaller document has."""
    return substrings.digest_kept(read_table(spark, sf_dir, "documents"))


def op10_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of each query among all embeddings."""
    return topk.exact_topk(read_table(spark, sf_dir, "embeddings"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by a shuffle of distinct words, and decoded."""
    import public_tokenizers

    return byte_bpe.digest_texts(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, and repaired by the cheapest edits."""
    return repair.repair(read_table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all embeddings by codebooks trained on all of them."""
    return codes.compress(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_collision_ann": op1_collision_ann,
    "op2_chat_format": op2_chat_format,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_quality_resample": op4_quality_resample,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_segment_topk": op10_segment_topk,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}

_HOSTS = ", ".join(f"('{h}')" for h in urls.BLOCKED_HOSTS)
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)


def _codes_sql() -> str:
    """Rounds of assignment and means, one after another; squared distances and means stay exact in doubles below 2^53."""
    steps = ["""kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT n, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x FROM kept, range(4) t(p)),
c0 AS (SELECT p, n - 1 AS e, x FROM parts WHERE n <= 256)"""]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT n, p, min((list_inner_product(a.x, a.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(a.x, c.x))::BIGINT * 256 + e) AS m FROM parts a JOIN c{r} c USING (p) GROUP BY ALL)""")
        if r < 4:
            steps.append(f"""m{r} AS (
    SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{r} JOIN parts USING (n, p), range(1, (SELECT max(len(x)) + 1 FROM parts)) t(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(y, x) AS x FROM c{r} LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS y FROM m{r} GROUP BY ALL) USING (p, e))""")
    steps.append("""coded AS (SELECT n, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY n),
digest AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS d FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM c4))""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, d AS codebooks_sha256 FROM kept JOIN coded USING (n), digest"""


ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": _codes_sql(),
    "op5_url_filter": f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES {_RULES}),
hosts(h) AS (VALUES {_HOSTS}),
fits AS (
    SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
listed AS (SELECT n, arg_max(h, length(h)) AS listed_host FROM parts JOIN hosts ON host = h OR ends_with(host, '.' || h) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed_host IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed_host
FROM parts LEFT JOIN fits USING (n) LEFT JOIN listed USING (n)""",
    "op10_segment_topk": """
WITH usable AS (
    SELECT vec_id, min(embedding) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) GROUP BY vec_id),
whole AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x::DOUBLE)) AS v FROM usable),
scored AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
    FROM whole q JOIN whole d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
