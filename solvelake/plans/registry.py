"""Query and oracle registry."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from solvelake.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The derived tables of ``sources.testbed`` in SQL.
VIEWS = """
teams as (
  select s_suppkey id, s_name name, n_name description, r_name affiliation, s_acctbal > 0 eligible,
         timestamp '2023-01-01 00:00:00' + s_suppkey * interval '1' minute inserted_at
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
users as (
  select c_custkey id, c_name name, lower(c_name) || '@example.com' email,
         case when c_acctbal >= 0 then c_custkey % (select count(*) from supplier) end team_id,
         c_acctbal > 1000 eligible, c_acctbal > 9500 admin
  from customer),
challenges as (
  select p_partkey id, p_name || '-' || cast(p_partkey as varchar) name, p_type description, p_brand flag,
         cast(100 + 10 * p_size as int) points, string_split(p_name, ' ') categories, p_size > 5 visible,
         'chall/' || cast(p_partkey as varchar) source_folder
  from part),
claims as (
  select e.event_id id, e.user_id, c.id challenge_id,
         date_trunc('second', e.ts + interval '500' millisecond) inserted_at,
         case when e.event_type = 'purchase' then c.flag else e.event_type end flag_guess
  from events e join challenges c on c.id = cast(json_extract_string(e.props, '$.k') as bigint)),
attempts as (
  select a.*, u.team_id, a.flag_guess = c.flag correct
  from claims a join users u on u.id = a.user_id join challenges c on c.id = a.challenge_id
  where u.team_id is not null),
successes as (
  select a.id attempt_id, a.user_id, a.challenge_id, a.team_id, a.inserted_at solved_at
  from attempts a
  where a.correct and not exists (
    select 1 from attempts b
    where b.correct and b.challenge_id = a.challenge_id and b.team_id = a.team_id
      and (b.inserted_at < a.inserted_at or (b.inserted_at = a.inserted_at and b.id < a.id)))),
links as (
  select page_id id, page_id // 5 challenge_id, url,
         case page_id % 4 when 0 then 'static' when 1 then 'web' when 2 then 'nc' else 'admin' end type
  from pages),
credentials as (
  select c_custkey user_id, c_mktsegment provider_name, c_name sub
  from customer where c_mktsegment <> 'HOUSEHOLD'),
signins as (
  select o_orderkey id, o_custkey user_id, 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') sub,
         case o_orderpriority when '1-URGENT' then 'AUTOMOBILE' when '2-HIGH' then 'BUILDING'
           when '3-MEDIUM' then 'FURNITURE' when '4-NOT SPECIFIED' then 'HOUSEHOLD' else 'MACHINERY' end provider
  from orders),
deploy_log as (
  select event_id seq, cast(json_extract_string(props, '$.k') as bigint) chall,
         case event_type when 'click' then 'building' when 'purchase' then 'success' when 'error' then 'failure'
           when 'signup' then 'started' else 'pulling' end status,
         value status_time, ts
  from events),
scored_teams as (
  select t.*, cast(coalesce((select sum(c.points) from successes s join challenges c on c.id = s.challenge_id
                             where s.team_id = t.id), 0) as bigint) score,
         (select max(s.solved_at) from successes s where s.team_id = t.id) last_solve
  from teams t)
"""


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query, with the SQL it must equal: ``sql`` selects from the derived tables and from ``ctes``."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            extra = f",\n{ctes}" if ctes else ""
            ORACLES[name] = f"with recursive {VIEWS.strip()}{extra}\n{sql.strip()}"
        return run

    return register
