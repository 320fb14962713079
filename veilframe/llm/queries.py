"""The corpus queries with the parameters of production, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    cross_tokenizer,
    decontaminate,
    exact_dedup,
    fill_in_middle,
    html_text,
    jaccard_join,
    katz,
    packing,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_filter.UrlRule("allow", "org/"),
    url_filter.UrlRule("block", "example.org/es/"),
    url_filter.UrlRule("block", "example.org/en/1"),
    url_filter.UrlRule("allow", "com/fr/"),
    url_filter.UrlRule("block", "com/de/"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_later_copies(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.aligned_tokens(
        _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"), katz.bucket_of("doc_id", 7) == 2)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(made)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
with t as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from t"""

OP6_SQL = f"""
with b as (select item_id, regexp_extract_all({_LOWER.format("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
win as (select distinct item_id, w[i:i + 9] as w from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i
        from b where len(w) > 0)),
sizes as (select distinct len(w) as n from win),
dw as (select doc_id, i, n, w[i:i + n - 1] as w from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes)),
hits as (select doc_id, i, n, item_id from dw join win using (w)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
items as (select doc_id, count(distinct item_id) as n_items,
          string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from hits group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

_BASE32 = " || ".join(f"to_base(('0x' || substr(h, {10 * i + 1}, 10))::bigint, 32, 8)" for i in range(4))
OP8_SQL = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as h, min(page_id) over (partition by b) as f from p)
select page_id, payload_bytes, translate(upper({_BASE32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV',
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
       case when f = page_id then 'response' else 'revisit' end as record_type,
       case when f <> page_id then f end as refers_to
from q"""

OP5_SQL = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k
        from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) as i from h)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from win) where n > 1),
edge as (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from again),
run as (select doc_id, i, sum(case when p is null or i > p + 200 then 1 else 0 end) over (partition by doc_id order by i) as r from edge),
span as (select doc_id, r, min(i) as a, max(i) + 200 as b from run group by 1, 2),
sums as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from span group by 1),
bounds as (select doc_id, b as a, lead(a) over (partition by doc_id order by a) as b from span
           union all select doc_id, 0, min(a) from span group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' order by a) as k
         from bounds join h using (doc_id) group by 1)
select h.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from h left join sums using (doc_id) left join kept using (doc_id)"""

OP9_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, w[i:i + 19] as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from later),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d where len(w) > 0),
kept as (select doc_id, string_agg(x, ' ' order by p) as k, count(*) as n from words anti join gone using (doc_id, p) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept using (doc_id)"""

OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
h as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2,
             ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
             t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 as plain from h),
x as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as e,
             case when plain then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from c)
select doc_id, len(u)::bigint as n, form, case when not plain then length(p) end as prefix_chars, case when not plain then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || e || '<M>' || m
              else '<S>' || e || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from x"""

#: name -> (query, SQL or None)
ENTRIES = {
    "op1_exact_dedup": (op1_exact_dedup, OP1_SQL),
    "op2_url_filter": (op2_url_filter, None),
    "op3_jaccard_join": (op3_jaccard_join, None),
    "op4_html_text": (op4_html_text, None),
    "op5_suffix_dedup": (op5_suffix_dedup, OP5_SQL),
    "op6_decontaminate": (op6_decontaminate, OP6_SQL),
    "op7_packing": (op7_packing, None),
    "op8_warc": (op8_warc, OP8_SQL),
    "op9_substring_dedup": (op9_substring_dedup, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_cross_tokenizer": (op11_cross_tokenizer, None),
    "op12_katz_scores": (op12_katz_scores, None),
    "op13_fill_in_middle": (op13_fill_in_middle, OP13_SQL),
}
