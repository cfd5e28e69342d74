"""Queries over repairs that wait for other evidence."""

from __future__ import annotations

from hearthledger.plans.catalogue import query, read
from hearthledger.streaming import repairs as R

EVIDENCE = ["event_id % 700 as repair_id", "event_id as version", "case when event_id % 97 = 13 then null when event_id % 7 = 3 then concat('h', event_id % 5) else concat('h', event_id % 700) end as evidence_hash"]


@query(f"""with e as (select {', '.join(EVIDENCE)} from events), f as (select repair_id, min(version) as first_version, arg_min(coalesce(evidence_hash, '-'), version) as first_hash from e group by repair_id),
o as (select e.*, first_hash, row_number() over (partition by repair_id order by version) as k from e join f using (repair_id) where first_hash = '-' or (version > first_version and coalesce(evidence_hash, '-') <> first_hash))
select repair_id, version, nullif(first_hash, '-') as before, evidence_hash as after, case when evidence_hash is null then 'ignored' else 'released' end as outcome from o where k = 1""")
def repairs_released(spark, sf_dir):
    """Repairs whose evidence changed, each with the change that released it."""
    return R.released_once(read(spark, sf_dir, "events").selectExpr(*EVIDENCE))
