"""Queries of the general training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrata.operators import schema_drift
from epistrata.runtime import Workspace
from epistrata.streaming import compaction

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.schema_changes(_t(spark, sf, "info_files")).select("repo_id", "file_index", "change", "old_field", "new_field")


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.unified_records(_t(spark, sf, "info_files"), _t(spark, sf, "raw_records")).table


def p4_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = schema_drift.unified_records(_t(spark, sf, "info_files"), _t(spark, sf, "raw_records")).fields
    return fields.withColumn("kinds", F.array_join("kinds", ","))


def _compacted(spark: SparkSession, sf: str) -> compaction.Compacted:
    return compaction.compact_small_files(compaction.payload_stream(spark, f"{sf}/small_files.parquet"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _compacted(spark, sf).duplicates


def p5_compacted(spark: SparkSession, sf: str) -> DataFrame:
    return _compacted(spark, sf).records.select("episode_index", "index")


def p5_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads in eight files taken up by a checkpointed stream, two a batch, in two runs: the duplicates over all batches."""
    ws = Workspace(spark, "batches")
    src, root = ws.path("in"), ws.path("out")
    files = _t(spark, sf, "small_files").select("file_id", "payload")
    for k in range(2):
        files.filter(F.pmod(F.col("file_id"), F.lit(2)) == k).repartition(4).write.mode("append").parquet(src)
        out = compaction.compact_small_files(compaction.payload_stream(spark, src, 2), root)
    return out.duplicates


def p5_files(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the files written: few, and none but the last of a batch far below the target."""
    r = _compacted(spark, sf).records
    return r.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("records"), F.max("_metadata.file_size").alias("bytes"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_found, p4_table, p4_fields, p5_found, p5_compacted, p5_batches, p5_files)}

_LINES = r"""
with lines as (select file_id, trim(replace(unnest(regexp_split_to_array(payload, '\r\n|\n|\r')), chr(65279), ''), ' ' || chr(9)) as line from small_files where payload is not null and payload <> ''),
obj as (select file_id, try_cast(line as json) as j from lines where starts_with(line, '{') and ends_with(line, '}')),
rec as (select try_cast(json_extract_string(j, '$.episode_index') as double)::bigint as episode_index, try_cast(json_extract_string(j, '$.index') as double)::bigint as "index" from obj where j is not null)
"""

_KIND = "case json_type({v}) when 'VARCHAR' then 'text' when 'BIGINT' then 'whole' when 'UBIGINT' then 'whole' when 'HUGEINT' then 'whole' when 'DOUBLE' then 'decimal' when 'ARRAY' then 'list' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' end"

_CHANGES = f"""
with recursive raw as (select repo_id, file_index, try_cast(info as json) as j, row_number() over (partition by repo_id, file_index, try_cast(info as json) is null order by written_at, file_id) as rn from info_files),
ok as (select repo_id, file_index, j, lag(file_index) over (partition by repo_id order by file_index) as prev from raw where j is not null and rn = 1),
k1 as (select repo_id, file_index, unnest(json_keys(j)) as k, j from ok), k2 as (select repo_id, file_index, unnest(json_keys(j, '$.features')) as k, j from ok),
f as (select repo_id, file_index, k as name, {_KIND.format(v="json_extract(j, '/' || k)")} as type, '' as mark from k1 where k <> 'features'
  union all select repo_id, file_index, 'features.' || k, 'feature ' || json_extract(j, '/features/' || k || '/dtype')::varchar || replace(json_extract(j, '/features/' || k || '/shape')::varchar, ' ', ''), coalesce(json_extract(j, '/features/' || k || '/names')::varchar, 'null') from k2),
gone as (select n.repo_id, n.file_index, a.name, a.type, a.mark from ok n join f a on a.repo_id = n.repo_id and a.file_index = n.prev left join f b on b.repo_id = n.repo_id and b.file_index = n.file_index and b.name = a.name where b.name is null),
new as (select n.repo_id, n.file_index, a.name, a.type, a.mark from ok n join f a on a.repo_id = n.repo_id and a.file_index = n.file_index left join f b on b.repo_id = n.repo_id and b.file_index = n.prev and b.name = a.name where n.prev is not null and b.name is null),
g1 as (select *, count(*) over (partition by repo_id, file_index, type, mark) as c from gone), n1 as (select *, count(*) over (partition by repo_id, file_index, type, mark) as c from new),
ren as (select g.repo_id, g.file_index, g.name as old_field, n.name as new_field from g1 g join n1 n on n.repo_id = g.repo_id and n.file_index = g.file_index and n.type is not distinct from g.type and n.mark = g.mark where g.c = 1 and n.c = 1)
"""

_DRIFT = _CHANGES + """
select repo_id, file_index, 'renamed' as change, old_field, new_field from ren
union all select g.repo_id, g.file_index, 'removed', g.name, '' from gone g left join ren r on r.repo_id = g.repo_id and r.file_index = g.file_index and r.old_field = g.name where r.old_field is null
union all select n.repo_id, n.file_index, 'added', '', n.name from new n left join ren r on r.repo_id = n.repo_id and r.file_index = n.file_index and r.new_field = n.name where r.new_field is null
union all select n.repo_id, n.file_index, 'type_changed', a.name, a.name from ok n join f a on a.repo_id = n.repo_id and a.file_index = n.file_index join f b on b.repo_id = n.repo_id and b.file_index = n.prev and b.name = a.name where a.type is not null and b.type is not null and a.type <> b.type
"""

_TEXT = "case when regexp_full_match({s}, '0|-?[1-9][0-9]*') then 'whole_text' when regexp_full_match({s}, '-?(0|[1-9][0-9]*)[.]0') then 'integral_text' when regexp_full_match({s}, '-?(0|[1-9][0-9]*)[.][0-9]*[1-9]') then 'decimal_text' else 'text' end"
_VALUE = f"""case json_type(v) when 'VARCHAR' then {_TEXT.format(s="json_extract_string(v, '$')")} when 'BIGINT' then 'whole' when 'UBIGINT' then 'whole' when 'DOUBLE' then case when abs(v::double) <= 9007199254740992 and v::double = trunc(v::double) then 'integral' else 'decimal' end
  when 'ARRAY' then case when len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) not in ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL'))) = 0 then 'numbers' else 'list' end when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' else 'null' end"""

#: Fields of the unified table: renames followed back to the first name, kinds of values, and the type that holds them all.
_FIELDS = _CHANGES + f""",
b0 as (select distinct repo_id, file_index as spot, substr(old_field, 10) as was_, substr(new_field, 10) as now_ from ren where starts_with(old_field, 'features.') and starts_with(new_field, 'features.')),
pv as (select r.repo_id, r.spot, r.was_, r.now_, max(p.spot) as pat from b0 r left join b0 p on p.repo_id = r.repo_id and p.now_ = r.was_ and p.spot < r.spot group by all),
oc as (select repo_id, spot, now_, was_ as origin, pat from pv union all select oc.repo_id, oc.spot, oc.now_, p.was_, p.pat from oc join pv p on p.repo_id = oc.repo_id and p.now_ = oc.origin and p.spot = oc.pat),
kv as (select distinct file_id, k, {_VALUE} as kind from (select file_id, k, json_extract(j, '/' || k) as v from (select file_id, j, unnest(json_keys(j)) as k from (select file_id, try_cast(record as json) as j from raw_records) where json_type(j) = 'OBJECT'))),
hit as (select ks.file_id, ks.k, arg_max(oc.origin, oc.spot) as origin from (select distinct file_id, k from kv) ks join (select distinct file_id, repo_id, file_index from info_files) p on p.file_id = ks.file_id join oc on oc.repo_id = p.repo_id and oc.now_ = ks.k and oc.spot <= p.file_index where oc.pat is null group by all),
named as (select ks.file_id, ks.k, coalesce(origin, ks.k) as f, count(*) over (partition by ks.file_id, coalesce(origin, ks.k)) as c from (select distinct file_id, k from kv) ks left join hit on hit.file_id = ks.file_id and hit.k = ks.k),
per as (select case when c > 1 then n.k else f end as field, n.file_id, n.k, kind from named n join kv on kv.file_id = n.file_id and kv.k = n.k),
fl as (select field, list_sort(list(distinct kind)) as kinds, count(distinct file_id) as files, count(distinct case when k <> field then file_id end) as renamed_in from per group by field),
pl as (select *, list_filter(kinds, lambda x: x <> 'null') as ks, list_distinct(list_transform(list_filter(kinds, lambda x: x <> 'null'), lambda x: replace(x, '_text', ''))) as ps from fl)
select field, field as "column", array_to_string(kinds, ',') as kinds, files, renamed_in, case when len(ks) = 0 or list_has_any(ps, ['text', 'object']) or len(list_filter(ks, lambda x: not ends_with(x, '_text'))) = 0 then 'string'
  when list_has_any(ps, ['numbers', 'list']) then case when list_has_all(['numbers', 'list'], ks) and list_contains(ks, 'list') then 'array<string>' when list_has_all(['numbers', 'whole', 'integral', 'decimal'], ps) then 'array<double>' else 'string' end
  when ks = ['boolean'] then 'boolean' when list_has_all(['whole', 'integral'], ps) and list_contains(ps, 'whole') then 'bigint' else 'double' end as type from pl
"""

ORACLES = {
    "p4_fields": _FIELDS,
    "p4_found": _DRIFT,
    "p5_found": _LINES + 'select episode_index, "index" from rec where episode_index is not null and "index" is not null group by all having count(*) > 1',
    "p5_batches": _LINES + 'select episode_index, "index" from rec where episode_index is not null and "index" is not null group by all having count(*) > 1',
    "p5_compacted": _LINES + 'select distinct episode_index, "index" from rec where episode_index is not null and "index" is not null',
}
