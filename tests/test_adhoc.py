"""Guarded SQL reads the named tables and nothing else."""

import pytest

from tonearm.plans import adhoc


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.range(20).selectExpr("id", "id % 3 as v"), "u": spark.range(2)}


PATH = "/root/testdata/sf0.001/region.parquet"


@pytest.mark.parametrize(
    "statement",
    [
        f"select count(*) from `org.apache.spark.sql.parquet`.`{PATH}`", f"select * from t where id in (select r_regionkey from `org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat`.`{PATH}`)",
        f"with a as (select * from PARQUET.`{PATH}`) select * from a", f"select (select count(*) from delta.`{PATH}`)", f"select * from u, lateral (select * from parquet.`{PATH}`)", f"select * from `{PATH}`",
        "select * from global_temp.adhoc_t", "select * from spark_catalog.default.t", "select * from nowhere", "show tables", "explain select 1", "use default", "merge into t using u on t.id = u.id when matched then delete",
        "select transform(id) using 'cat' from t", "select system.builtin.reflect('java.util.UUID', 'randomUUID')", "values (try_reflect('java.util.UUID', 'randomUUID'))", "declare x int", "begin select 1; end",
    ],
)
def test_what_is_no_read_of_the_tables_is_refused(spark, tables, statement):
    with pytest.raises(Exception) as caught:
        adhoc.run(spark, tables, tables, statement)
    assert isinstance(caught.value, adhoc.Refused) or "ParseException" in type(caught.value).__name__


@pytest.mark.parametrize(
    "statement, rows",
    [
        ("with a as (select v, count(*) n from t group by v having count(*) > 6) select sum(n) s from a", 1), ("select v, id, row_number() over (partition by v order by id) r from T where exists (select 1 from u where u.id = t.id)", 2), ("select * from (values (1), (2)) as x(y) union all select id from u", 4),
        ("select * from t pivot (count(id) for v in (0, 1, 2))", 1), ("select explode(array(1, 2)) e from u", 4), ("select * from range(3)", 3), ("select * from u, lateral (select max(id) m from t where t.v = u.id)", 2), ("select a.id from t a full outer join u b using (id) order by 1 limit 3 offset 1", 3),
        ("with recursive r(n) as (select 1 union all select n + 1 from r where n < 4) select * from r", 4), ("select v, sum(id) over w from t window w as (partition by v)", 20), ("select distinct v from t intersect select id from u", 2), ("select id, x from t lateral view explode(array(v)) e as x", 20),
        ("select v, count(*) from t group by rollup (v)", 4), ("select /*+ broadcast(u) */ t.id from t join u on t.id = u.id", 2), ("select * from u tablesample (100 percent)", 2), ("select * from t unpivot (x for c in (id, v))", 40),
    ],
)
def test_reads_pass(spark, tables, statement, rows):
    assert len(adhoc.run(spark, tables, tables, statement).rows) == rows
