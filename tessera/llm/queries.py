"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cuckoo, decontaminate, html_text, jaccard, mixing, ngram_lm, pii, quality, token_files, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_read(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _read(spark, sf_dir, "labels")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_read(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _read(spark, sf_dir, "labels")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.score_documents(_read(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_output(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_classifier,
        op3_benchmark_decontamination,
        op4_html_extraction,
        op5_exact_dedup,
        op6_toxicity,
        op7_lm_scoring,
        op8_source_mixing,
        op9_personal_data,
        op10_token_output,
    )
}

_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""
with recursive w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
t as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
      from t a join t b on a.g = b.g and a.doc_id < b.doc_id and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n group by all),
l as (select x, y from p where 100 * i >= 90 * (na + nb - i)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as a, doc_id as b from s union select r.a, e.y from r join e on r.b = e.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id
from s join (select a, min(b) as c from r group by a) m on m.a = s.doc_id""",
    "op5_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) as h from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256 from t""",
    "op7_lm_scoring": rf"""
with w as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
t as (select r, w, unnest(range(1, len(w) + 1)) as i from w),
g as (select r, w[i] as c, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a from t),
n as (select count(*) as n from g),
u as (select c, count(*) as k from g group by all),
ud as (select r, c, count(*) as k from g group by all),
bi as (select b, c, count(*) as k from g where b is not null group by all),
bd as (select r, b, c, count(*) as k from g where b is not null group by all),
tr as (select a, b, c, count(*) as k from g where a is not null group by all),
td as (select r, a, b, c, count(*) as k from g where a is not null group by all),
x as (select g.r, g.a, g.b, u.k - ud.k as k1, bi.k - bd.k as k2, tr.k - td.k as k3, ub.k - ubd.k as h1, bb.k - bbd.k as h2
      from g join u using (c) join ud using (r, c)
      left join bi on bi.b = g.b and bi.c = g.c left join bd on bd.r = g.r and bd.b = g.b and bd.c = g.c
      left join tr on tr.a = g.a and tr.b = g.b and tr.c = g.c left join td on td.r = g.r and td.a = g.a and td.b = g.b and td.c = g.c
      left join u ub on ub.c = g.b left join ud ubd on ubd.r = g.r and ubd.c = g.b
      left join bi bb on bb.b = g.a and bb.c = g.b left join bd bbd on bbd.r = g.r and bbd.b = g.a and bbd.c = g.b),
s as (select r, case
        when k3 > 0 then ln(k3) - ln(h2)
        else case when a is not null then ln(0.4) else 0 end + case
          when k2 > 0 then ln(k2) - ln(h1)
          else case when b is not null then ln(0.4) else 0 end + ln(greatest(k1, 0.5)) - ln((select n from n)) end end as s from x),
d as (select r, count(*) as n, sum(s) as s from s group by r)
select w.doc_id, coalesce(d.n, 0) as n_words, round(coalesce(d.s, 0.0), 3) as log_score, round(d.s / d.n, 5) as mean_log_score
from w left join d using (r)""",
}
