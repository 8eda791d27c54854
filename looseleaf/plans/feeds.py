"""Queries on snapshots and change feeds."""

from __future__ import annotations

from looseleaf.operators.change_feed import profile_rows
from looseleaf.operators.snapshot_diff import snapshot_changes
from looseleaf.sources.tables import table

QUERIES = {
    "p2_found": lambda spark, d: snapshot_changes(table(spark, d, "index_manifest")),
    "p4_found": lambda spark, d: profile_rows(table(spark, d, "profile_ops")),
}

SQL = {
    "p2_found": """
with t as (
  select snapshot_no, lower(trim(uid)) as uid, lower(sha256) as sha,
         delivery_no = max(delivery_no) over (partition by snapshot_no) as last
  from index_manifest
), s as (select distinct snapshot_no, uid, sha from t where last),
n as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as prev, lead(snapshot_no) over (order by snapshot_no) as next
      from (select distinct snapshot_no from s) q),
a as (select s.* from s join n using (snapshot_no) where prev is not null),
b as (select next as snapshot_no, uid, sha from s join n using (snapshot_no) where next is not null)
select coalesce(a.snapshot_no, b.snapshot_no) as snapshot_no, coalesce(a.uid, b.uid) as uid,
       case when b.uid is null then 'new' when a.uid is null then 'removed' else 'changed' end as status
from a full join b on a.snapshot_no = b.snapshot_no and a.uid = b.uid
where a.uid is null or b.uid is null or a.sha is distinct from b.sha
""",
    "p4_found": """
with o as (
  select distinct user_id, seq, op, coalesce(field, '') as field, coalesce(item_id, '') as item_id, coalesce(text, '') as text from profile_ops
), l as (select * from o where field in ('chronic_conditions', 'allergies', 'medications', 'habits', 'ongoing_complaints')),
adds as (
  select user_id, field, seq, substr(field, 1, 1) || row_number() over (partition by user_id, field order by seq) as item_id
  from l where op = 'add' and text <> ''
), items as (
  select a.user_id, a.field, a.item_id,
         greatest(a.seq, coalesce((select max(u.seq) from l u where u.user_id = a.user_id and u.field = a.field and u.item_id = a.item_id
                                   and u.op = 'update' and u.text <> '' and u.seq > a.seq), 0)) as value_no
  from adds a
  where not exists (select 1 from l r where r.user_id = a.user_id and r.field = a.field and r.item_id = a.item_id and r.op = 'remove' and r.seq > a.seq)
)
select user_id, field, item_id, cast(value_no as int) as value_no from items
union all
select user_id, substr(op, 5) as field, '' as item_id, cast(max(seq) as int) as value_no from o
where op = 'set_notes' or op = 'set_sex' and text <> ''
   or op = 'set_birth_date' and regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(text as date) is not null
group by user_id, op
union all
select user_id, 'id_counters' as field, field as item_id, cast(count(*) as int) as value_no from adds group by user_id, field
""",
}
