"""The registered queries ``opN_<name>`` and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewire.llm import (
    attention_lm, chat_trees, exact_blocks, language, license_templates, mixing, packing, periodic_runs, quality_forest,
    secret_spans, shallot, simhash_grid, toxicity,
)
from tidewire.llm.text import remainder

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SUBWORD_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select(
        "doc_id",
        (remainder("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_grid.near_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), PACKING_TOKENIZER)
    return packed.withColumnRenamed("id", "doc_id").drop("row")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(_table(spark, sf_dir, "documents"), SUBWORD_RANKS).withColumnRenamed("id", "doc_id").drop("row")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans.scan(_table(spark, sf_dir, "documents"))
    counts = [
        secret_spans.number_of(F.col("base"), kind).alias(f"n_{name}")
        for kind, (name, *_) in enumerate(secret_spans.KINDS[: secret_spans.GENERIC])
    ]
    base = F.sha2(secret_spans.spans_text(F.col("base")), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts, base, secret_spans.spans_text(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op6_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_forest.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *quality_forest.BASE, "base_failed", "kept", "anomaly")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.detect(docs, language.train(docs)).withColumnRenamed("id", "doc_id")
    held_out = (remainder("doc_id", language.FOLDS) == language.HELD_OUT).alias("held_out")
    return found.select("doc_id", held_out, F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = [(-7, i, role, "\\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    turns = turns.unionByName(spark.createDataFrame(tricky, turns.schema))
    read = chat_trees.read_back(chat_trees.formatted_paths(chat_trees.turn_nodes(turns)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_blocks.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op11_shallot_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shallot.cluster(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_templates.scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return periodic_runs.detect(docs, change=periodic_runs.planted).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_forest": op6_quality_forest,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_chat_trees": op9_chat_trees,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_shallot_clustering": op11_shallot_clustering,
    "op12_license_scan": op12_license_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_PATTERNS = ((_ASSIGN, 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24), ("[A-Za-z0-9+/_=-]+", 0, 20))
_SECRET_KINDS = "\n    union all ".join(
    f"""select doc_id, source, {k} as kind, {least} as least, regexp_extract_all(t, '{pattern}', 0) as found,
        regexp_extract_all(t, '{pattern}', {group}) as inner_values, string_split_regex(t, '{pattern}') as gaps from texts"""
    for k, (pattern, group, least) in enumerate(_SECRET_PATTERNS)
)

# Five rounds spelled out: assign all vectors, then floors of the means of clusters that have any.
_NEAREST = "list_dot_product(v, v) - 2 * list_dot_product(v, f) + list_dot_product(f, f)"
_KMEANS = ",\n".join(
    f"""near{i} as materialized (
    select n, any_value(vec_id) as vec_id, any_value(v) as v, min(struct_pack(d := ({_NEAREST})::bigint, c := c)) as best
    from kept cross join cent{i} group by n)"""
    + (
        ""
        if i == shallot.ROUNDS
        else f""",
mean{i} as materialized (
    select c, list(x order by place) as f from (
        select best.c as c, place, floor(sum(v[place]) / count(*)) as x from near{i}, generate_series(1, {shallot.DIMS}) as s(place)
        group by best.c, place) group by c),
cent{i + 1} as materialized (select c, coalesce(m.f, o.f) as f from cent{i} o left join mean{i} m using (c))"""
    )
    for i in range(shallot.ROUNDS + 1)
)

_PLACES = " || ".join(
    "list_transform(list_filter(range(1, len(w) + 1), lambda i: {}), lambda i: struct_pack(place := i - 1, label := '{}'))".format(
        " and ".join(f"w[i + {k}] = '{word}'" if k else f"w[i] = '{word}'" for k, word in enumerate(phrase.split())), label
    )
    for phrase, label in license_templates.PHRASES.items()
)
_TEMPLATES = [(label, license_templates.parse(text)) for label, text in license_templates.TEMPLATES]
_TEMPLATE_HITS = ", ".join(
    f"case when regexp_matches(line, '{license_templates.as_pattern(parts)} ') then struct_pack(label := '{label}', m := {license_templates.mandatory_words(parts)}) end"
    for label, parts in _TEMPLATES
)
_PHRASE_HITS = ", ".join(
    f"case when contains(line, ' {phrase} ') then struct_pack(label := '{label}', m := {len(phrase.split())}) end"
    for phrase, label in license_templates.PHRASES.items()
)

ORACLES = {
    "op11_shallot_clustering": f"""
with kept as materialized (
    select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor({shallot.SCALE} * x::double)) as v
    from embeddings where len(embedding) = {shallot.DIMS} and len(list_filter(embedding, lambda x: isfinite(x))) = {shallot.DIMS}),
cent0 as materialized (
    select (row_number() over (order by sha256('{shallot.SALT}:' || vec_id), vec_id, v) - 1)::int as c, v as f
    from kept order by c limit {shallot.CLUSTERS}),
{_KMEANS},
found as (select vec_id, best.c as cluster, best.d as distance from near{shallot.ROUNDS})
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string(list_transform(f, lambda x: x::bigint::varchar), ',')) as centroid_sha256
from found join cent{shallot.ROUNDS} on c = cluster""",
    "op12_license_scan": rf"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
lines as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as line from words),
hits as (
    select doc_id, w, {_PLACES} as places,
           list_filter([{_TEMPLATE_HITS}, {_PHRASE_HITS}], lambda h: h is not null) as hits
    from lines)
select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_base,
       list_min(list_transform(places, lambda p: p.place))::bigint as first_word,
       list_max(list_transform(places, lambda p: p.place))::bigint as last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.label))), ',') as labels,
       coalesce(list_max(list_transform(hits, lambda h: h.m / (h.m + {license_templates.HALF}))), 0)::double as score
from hits""",
    "op5_secret_scan": f"""
with texts as (select doc_id, source, coalesce(text, '') as t from documents),
raw as ({_SECRET_KINDS}),
each as (
    select doc_id, source, kind, least, unnest(inner_values) as value, unnest(found) as hit,
           unnest(gaps[:len(found)]) as gap, generate_subscripts(found, 1) as i
    from raw where len(found) > 0),
placed as (
    select *, sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i rows unbounded preceding)::bigint as stop
    from each),
spans as (select doc_id, source, kind, value, stop - length(hit) as start, stop from placed where length(value) >= least),
candidates as (
    select * from spans s where kind < 3 or (
        regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]')
        and not exists (select 1 from spans b where b.doc_id = s.doc_id and b.kind < 3 and s.start < b.stop and b.start < s.stop))),
owners as (
    select value, count(distinct coalesce(source, '')) as owners, count(distinct coalesce(source, '') || chr(31) || coalesce(doc_id::varchar, '')) as repositories
    from candidates group by value),
told as (
    select c.*, owners >= 3 or repositories >= 50 as copied, kind < 3 or (owners < 3 and repositories < 50) as shown, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || start || ':' || stop as span
    from candidates c join owners using (value)),
per_doc as (
    select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
           count(*) filter (where kind = 2) as n_hex,
           coalesce(string_agg(span, ',' order by start, kind) filter (where kind < 3), '') as base,
           string_agg(span, ',' order by start, kind) filter (where shown) as spans,
           count(*) filter (where not copied) as n_live, count(*) filter (where copied) as n_copied
    from told group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live,
       coalesce(n_copied, 0) as n_copied
from documents d left join per_doc using (doc_id)""",
    "op8_source_mixing": r"""
with recursive docs as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
           (('0x' || substr(md5('0' || chr(31) || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5)
           / 4503599627370496.0 as u
    from documents),
odds as (select *, u / (1.0::double - u) / sqrt(greatest(size, 1)::double) as rank from docs),
sources as (
    select source, source_size, 2 * source_size as stop,
           [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
    from (select source, sum(size)::bigint as source_size from docs group by source)),
shared as (
    select 0 as round, source, source_size, stop, weight, false as full_up,
           1.5 * (sum(source_size) over ()) * weight / (sum(weight) over ()) as target
    from sources
    union all
    select round + 1, source, source_size, stop, weight, full_up or target >= stop,
           case when full_up or target >= stop then stop::double
                else (1.5 * (sum(source_size) over ()) - sum(case when full_up or target >= stop then stop else 0 end) over ())
                     * weight / sum(case when full_up or target >= stop then 0 else weight end) over () end
    from shared where round < (select count(*) from sources)),
targets as (select source, source_size, target from shared where round = (select max(round) from shared)),
ranked as (
    select d.*, t.source_size, t.target,
           case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as sure,
           sum(size) over (partition by d.source order by rank, doc_id rows unbounded preceding) as upto
    from odds d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (sure + case when target - source_size * sure > 0 and upto - size / 2 <= target - source_size * sure
                            then 1 else 0 end))::bigint as taken
from ranked""",
    "op9_chat_trees": r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
    select *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) as body,
           length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) as head
    from turns),
whole as (
    select conv_id, count(*) as n_turns,
           string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
           coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
           sum(4 + head + 2 + body + 8)::bigint as formatted_chars
    from sized group by conv_id)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from whole""",
    "op10_exact_dedup": """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))""",
}
