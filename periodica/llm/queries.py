"""The operators' registered queries: each derives its digest columns from the operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.llm import ann, embedding_dedup, filter_audit, line_dedup, middle, mixing, ngram_join, packing, passages, secrets, suffix_dedup, token_counts, toxicity

#: Documents of at least this score count as toxic.
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"), "n_random")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "neighbours", "terms")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "pieces")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size", "kept", "size")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.shuffled(table(spark, sf_dir, "documents"))
    text = middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_join": op9_ngram_join,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op4_embedding_dedup": """with recursive usable as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
reached as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reached r join links l on l.a = r.b),
counted as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e left join counted on counted.a = e.vec_id join (select a, min(b) as component_id from reached group by a) c on c.a = e.vec_id""",
    "op9_ngram_join": r"""with recursive grams as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)),
sets as (select g, min(doc_id) as a, count(*) as copies, len(g) as size from grams where len(g) > 0 group by g),
each as (select a, size, unnest(g) as s from sets),
links as (select a, b from (select x.a, y.a as b, any_value(x.size) as size_a, any_value(y.size) as size_b, count(*) as c from each x join each y on x.s = y.s and x.a <> y.a group by x.a, y.a) where c / (size_a + size_b - c) >= 0.8),
reached as (select a, a as b from sets union select r.a, l.b from reached r join links l on l.a = r.b),
classes as (select a, min(b) as class_id from reached group by a),
linked as (select l.a, sum(copies) as n from links l join sets s on s.a = l.b group by l.a),
rows as (select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(s.copies - 1, 0) + coalesce(n, 0) as n_links, coalesce(s.size, 0) as size from grams d left join sets s on s.g = d.g and len(d.g) > 0 left join classes c using (a) left join linked using (a))
select doc_id, class_id, n_links::bigint as n_links, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept, size::bigint as size from rows""",
    "op10_suffix_dedup": """with texts as (select doc_id, encode(coalesce(text, '')) as h, strlen(coalesce(text, '')) as n from documents),
starts as (select doc_id, p, md5_number(h[p + 1:p + 50]) as s from (select doc_id, h, unnest(range(n - 49)) as p from texts where n >= 50)),
firsts as (select s, min(doc_id) as first from starts group by s having min(doc_id) <> max(doc_id)),
hits as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from starts join firsts using (s) where doc_id > first),
runs as (select doc_id, min(p) as low, max(p) + 50 as high from (select *, sum((before is null or p > before + 50)::int) over (partition by doc_id order by p) as run from hits) group by doc_id, run),
edges as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as after from runs),
pieces as (select r.doc_id, string_agg(hex(h[after + 1:low]), '' order by low) as kept, max(high) as last, sum(high - low) as removed, count(*) as spans from edges r join texts using (doc_id) group by r.doc_id)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(case when last is null then h else unhex(kept || hex(h[last + 1:])) end) as kept_sha256 from texts left join pieces using (doc_id)""",
    "op11_line_dedup": """with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from documents),
keyed as (select *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line_key from lines),
repeated as (select line_key, max(doc_id) as last from keyed where length(line_key) >= 40 group by line_key having count(distinct doc_id) >= 5),
marked as (select k.*, coalesce(k.doc_id <> r.last, false) as gone from keyed k left join repeated r using (line_key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256 from marked group by doc_id""",
    "op12_filter_audit": r"""with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marks as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
rows as (select part, concat(case when len(words) < 200 then 'A' else '' end, case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end,
  case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 'C' else '' end, case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end,
  case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end) as fails, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad from texts left join marks using (doc_id)),
groups as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where bad) as bad from rows group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (select concat(a.l, b.l, c.l, d.l, e.l) as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select o, s, substr(o, s, 1) as l, concat('[-', substr(o, 1, s - 1), ']') as earlier from orders, range(1, 6) as r(s)),
met as (select part, o, s, l, n, good, bad, fails, contains(fails, l) as hit, regexp_matches(fails, earlier) as gone from groups, steps),
summed as (select part, o, s, l, sum(case when not gone and not hit then n else 0 end) as kept, sum(case when not gone and hit then n else 0 end) as removed, sum(case when gone and hit then n else 0 end) as redundant,
  sum(case when fails = l then n else 0 end) as unique_fails, sum(case when not gone and hit then good else 0 end) as good_lost, sum(case when not gone and hit then bad else 0 end) as toxic_lost from met group by part, o, s, l)
select part, o as filter_order, s::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, l))::bigint as shapley from summed""",
    "op13_fill_in_middle": """with cut as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256(concat('1:', doc_id)) as digits from documents),
numbers as (select *, len(tokens) as n, ('0x' || substr(digits, 1, 8))::bigint as h1, ('0x' || substr(digits, 9, 8))::bigint as h2, ('0x' || substr(digits, 17, 8))::bigint as h3, ('0x' || substr(digits, 25, 8))::bigint as h4 from cut),
formed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers),
parts as (select *, array_to_string(tokens[1:low], '') as prefix, array_to_string(tokens[low + 1:high], '') as middle, array_to_string(tokens[high + 1:], '') as suffix from formed)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then concat('<P>', prefix, '<S>', suffix, '<M>', middle) else concat('<S>', suffix, '<P>', prefix, '<M>', middle) end) as output_sha256, sha256(text) as restored_sha256 from parts""",
}
