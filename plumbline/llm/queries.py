"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bpe_tree import encode
from plumbline.llm.common import table
from plumbline.llm.language import identify
from plumbline.llm.licenses import license_scan
from plumbline.llm.line_dedup import BLOCKS, page_line_dedup
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.mixing import mix_totals
from plumbline.llm.negatives import hard_negatives
from plumbline.llm.quantizer import quantize
from plumbline.llm.secrets import scan
from plumbline.llm.spotsigs import fingerprints
from plumbline.llm.token_counts import token_counts
from plumbline.llm.topk import top_k
from plumbline.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_totals(table(spark, sf_dir, "documents"), weights=[1, 2, 3], most=3)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cutoff=0.7)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_line_dedup(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize(table(spark, sf_dir, "embeddings"), scale=256.0, parts=16, entries=64, rounds=2).drop("label")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90)


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


ALL: list[Query] = [
    op1_token_counts, op2_source_mix, op3_toxicity, op4_secret_scan, op5_near_duplicates, op6_bpe_codec, op7_top_k,
    op8_spot_signatures, op9_license_scan, op10_line_dedup,
    op11_vector_codes, op12_hard_negatives, op13_language,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


TOP_K_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) as w from embeddings),
d as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::bigint as score
 from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from d)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""

LINE_SQL = """with h as (select page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') as host,
 list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)', chr(10), 'g'), '(?is)<script\\b.*?(?:</script\\s*>|\\z)', chr(10), 'g'), '(?is)<style\\b.*?(?:</style\\s*>|\\z)', chr(10), 'g'),
  '(?i)\\n|</?(?:BLOCKS)\\b[^>]*>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ')), lambda x: x <> '') as lines from pages),
k as (select *, array_to_string(lines, chr(10)) as page from h),
t as (select host, count(distinct page) as host_pages from k group by host),
c as (select host, line, count(distinct page) as n from (select host, page, unnest(lines) as line from k) group by host, line),
b as (select c.host, list(c.line) as gone from c join t on c.host is not distinct from t.host where n >= 3 and n > 0.1::double * host_pages group by c.host),
o as (select page_id, k.host, lines, list_filter(lines, lambda x: not list_contains(coalesce(gone, []), x)) as kept from k left join b on k.host is not distinct from b.host)
select page_id, host, len(lines)::bigint as n_lines, (len(lines) - len(kept))::bigint as n_dropped, array_to_string(kept, chr(10)) as text from o""".replace("BLOCKS", BLOCKS)


#: What both SQL texts over embeddings begin with: whole numbers of the rows that take part.
_WHOLE = "list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint)"
_SOUND = "embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) is not false"


def _codes_sql() -> str:
    """Full search in every round, one row for each row, part and position."""
    assign = """n{i} as (select r, part, entry, dist from (select x.r, x.part, e.entry, sum((x.v - e.v) * (x.v - e.v)) as dist,
 row_number() over (partition by x.r, x.part order by sum((x.v - e.v) * (x.v - e.v)), e.entry) as nth
 from x join e{i} e using (part, place) group by x.r, x.part, e.entry) where nth = 1)"""
    update = """m{i} as (select n.part, n.entry, x.place, floor(sum(x.v)::double / count(*))::bigint as v from n{i} n join x using (r, part) group by n.part, n.entry, x.place),
e{j} as (select e.part, e.entry, e.place, coalesce(m.v, e.v) as v from e{i} e left join m{i} m using (part, entry, place))"""
    steps = ",\n".join([assign.format(i=0), update.format(i=0, j=1), assign.format(i=1), update.format(i=1, j=2), assign.format(i=2)])
    return f"""with k as (select row_number() over (order by vec_id) as r, vec_id, label, {_WHOLE} as w from embeddings where {_SOUND}),
x as (select r, (p - 1) // 4 as part, (p - 1) % 4 as place, w[p] as v from (select r, w, unnest(range(1, 65)) as p from k)),
e0 as (select part, r - 1 as entry, place, v from x where r <= 64),
{steps},
b as (select sha256(string_agg(v::varchar, ',' order by part, entry, place)) as codebooks_sha256 from e2),
o as (select k.vec_id, k.label, string_agg(printf('%02x', n.entry), '' order by n.part) as code, sum(n.dist)::bigint as error from k join n2 n using (r) group by k.r, k.vec_id, k.label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from o, b"""


NEGATIVES_SQL = f"""with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {_WHOLE} as w from embeddings where label is not null and {_SOUND}),
d as (select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as same, list_sum(list_transform(list_zip(a.w, c.w), lambda p: p[1] * p[2]))::bigint as score
 from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, other) as nth from d where same) where nth <= 5),
n as (select p.anchor_id, p.other as positive_id, d.other as negative_id, p.score as positive_score, d.score as negative_score,
 row_number() over (partition by p.anchor_id, p.other order by d.score desc, d.other) as rank
 from p join d on d.anchor_id = p.anchor_id and not d.same and 30 * p.score <= 100 * d.score and 100 * d.score <= 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op7_top_k": TOP_K_SQL, "op10_line_dedup": LINE_SQL, "op11_vector_codes": _codes_sql(), "op12_hard_negatives": NEGATIVES_SQL}
