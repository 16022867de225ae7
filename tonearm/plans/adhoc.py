"""Read-only SQL over a warehouse's tables, and what those tables look like."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.listening import COMPLETION_MS

# Rows shown where the caller doesn't say, rows shown at most, and seconds a statement may take.
DEFAULT_ROWS, MAX_ROWS, MAX_SECONDS = 200, 5_000, 15
# Fixed value: how long a count of a table is good for.
COUNT_SECONDS = 60
#: Nodes that a parsed read is made of; a statement with any other node is refused.
READS = (
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation",
    "Offset", "OneRowRelation", "Pivot", "Project", "ResolvedInlineTable", "Sample", "Sort", "SubqueryAlias", "Union", "UnionLoop", "UnionLoopRef", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrdinal",
    "UnresolvedPivot", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
)
#: Groups of built-in functions that statements may call; of the others (files, sessions, reflection) only MISC.
GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs",
    "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "window_funcs",
)
MISC = ("typeof", "bitmap_count", "bitmap_bit_position", "bitmap_bucket_number", "range")
#: Generators that tell about the system and not about their arguments.
SYSTEM = ("collations", "sql_keywords")
#: Expressions that statements are made of besides functions: names, literals, operators without a name, subqueries, windows and what analysis adds.
PLUMBING = (
    "Alias", "AttributeReference", "OuterReference", "Literal", "Cast", "ScalarSubquery", "ListQuery", "Exists", "InSubquery", "LateralSubquery", "SortOrder", "AggregateExpression", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame",
    "UnspecifiedFrame$", "CurrentRow$", "UnboundedPreceding$", "UnboundedFollowing$", "LambdaFunction", "NamedLambdaVariable", "GetStructField", "GetArrayStructFields", "GetArrayItem", "GetMapValue", "ElementAt", "CreateNamedStruct", "CaseWhen", "If", "In", "Between",
    "GroupingID", "Grouping", "EqualNullSafe", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "ILike", "MultiAlias", "Coalesce", "UpCast", "PivotFirst", "BaseGroupingSets", "Cube", "Rollup", "GroupingSets", "KnownNotNull", "KnownNullable", "ArrayTransform",
    "TimestampAddInterval", "DatetimeSub", "TimeAdd", "DateAddInterval", "DateAddYMInterval", "TimestampAddYMInterval", "TimestampAdd", "TimestampDiff", "SubtractDates", "SubtractTimestamps", "DivideYMInterval", "DivideDTInterval", "MultiplyYMInterval", "MultiplyDTInterval",
    "PreciseTimestampConversion", "TimeWindow", "SessionWindow", "Collate", "SQLFunctionExpression", "SQLScalarFunction",
)


class Refused(ValueError):
    """A statement that isn't a plain read."""


@dataclass
class Allowed:
    """What statements may call: names of functions, and classes of expressions."""

    names: frozenset[str]
    classes: frozenset[str]


_ALLOWED: dict[int, Allowed] = {}


def allowed(spark: SparkSession) -> Allowed:
    """The built-in functions of the allowed groups and the expressions that they become."""
    jvm = spark._jvm
    if id(jvm) not in _ALLOWED:
        infos = [(i.getName(), i.getGroup(), i.getClassName()) for i in jvm.org.apache.spark.sql.api.python.PythonSQLUtils.listBuiltinFunctionInfos()]
        may = [(n, c) for n, g, c in infos if (g in GROUPS and n not in SYSTEM) or n in MISC]
        _ALLOWED[id(jvm)] = Allowed(frozenset(n for n, _ in may), frozenset(re.sub("(Expression|Generator)?Builder(Base)?$", "", c.rsplit(".", 1)[-1]) for _, c in may) | frozenset(PLUMBING))
    return _ALLOWED[id(jvm)]


def _items(seq) -> Iterable:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _strings(seq) -> list[str]:
    return [seq.apply(k) for k in range(seq.size())]


def _everything(spark: SparkSession, plan) -> Iterable:
    """All that a parsed plan holds: nodes, expressions, and what stands in their lists, maps and pairs."""
    from py4j.java_gateway import JavaObject, is_instance_of

    gateway, todo = spark.sparkContext._gateway, [plan]
    while todo:
        x = todo.pop()
        if not isinstance(x, JavaObject):
            continue
        yield x
        if is_instance_of(gateway, x, "scala.collection.Iterable"):
            todo += _items(x)
        elif is_instance_of(gateway, x, "scala.Product") and not is_instance_of(gateway, x, "org.apache.spark.sql.types.DataType"):
            todo += _items(x.productIterator())


def _kind(x) -> str:
    return x.getClass().getName().rsplit(".", 1)[-1]


def check(spark: SparkSession, statement: str, names: Iterable[str], own: Iterable[str] = ()):
    """Refuses what isn't a read of the named tables; gives the parsed plan. own: functions of the session besides the built-in ones.

    Every node of the parsed plan must be one of READS, every relation a single name, that of a table or of a WITH of
    the statement, and every function one that is allowed; so neither commands, nor files, nor other catalogs, nor
    calls into the JVM get through, wherever in the statement they stand.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    may, is_a = allowed(spark).names | {f.lower() for f in own}, spark.sparkContext._jvm.py4j.reflection.TypeUtil
    known, relations = {n.lower() for n in names}, []
    for x in _everything(spark, plan):
        kind = _kind(x)
        if kind == "UnresolvedFunction":
            _called(_strings(x.nameParts()), may)
        elif kind == "UnresolvedTableValuedFunction":
            _called(_strings(x.name()), may)
        elif kind == "UnresolvedRelation":
            relations.append(_strings(x.multipartIdentifier()))
        elif kind == "UnresolvedWith":
            known |= {pair._1().lower() for pair in _items(x.cteRelations())}
        if is_a.isInstanceOf("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", x) and kind not in READS:
            raise Refused(f"only reads are allowed, not {kind}")
    for parts in relations:
        if len(parts) > 1 or parts[0].lower() not in known:
            raise Refused(f"there is no table {'.'.join(parts)}; tables are read by name, not by path")
    return plan


def _called(parts: list[str], may: Iterable[str]) -> None:
    if len(parts) > 1 or parts[0].lower() not in may:
        raise Refused(f"{'.'.join(parts)} is not allowed")


def check_resolved(spark: SparkSession, df: DataFrame) -> None:
    """Refuses a statement with an expression that isn't allowed, after names have become expressions. What tables are made of isn't looked at."""
    may = allowed(spark).classes
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if _kind(node) == "View":
            continue
        todo += [*_items(node.children()), *_items(node.subqueries())]
        exprs = list(_items(node.expressions()))
        while exprs:
            e = exprs.pop()
            kind = _kind(e)
            if kind not in may:
                raise Refused(f"{e.prettyName()} ({kind}) is not allowed")
            # What an allowed function is replaced by is Spark's own; its arguments are the statement's.
            exprs += _items(e.parameters() if _replaced(spark, e) else e.children())


def _replaced(spark: SparkSession, e) -> bool:
    return spark.sparkContext._jvm.py4j.reflection.TypeUtil.isInstanceOf("org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules", e)


# --- functions for statements

_SINGLE = {k: v for k, v in text.SPELLED.items() if len(v) == 1}


def _quoted(s: str) -> str:
    return "r'" + s + "'"


def _plain(x: str) -> str:
    """Lower case without marks, null as empty: functions.text.unaccent in SQL."""
    x = f"coalesce({x}, '')"
    for letter, spelled in text.SPELLED.items():
        if len(spelled) > 1:
            x = f"replace({x}, '{letter}', '{spelled}')"
    return f"lower(translate({x}, '{text.ACCENTED + ''.join(_SINGLE)}', '{text.PLAIN + ''.join(_SINGLE.values())}'))"


def _ragged(x: str) -> str:
    """functions.times.ragged_date in SQL."""
    part = lambda at, least, high: f"if(length({x}) >= {least} and substr({x}, {at}, 2) rlike '^[0-9][0-9]$' and substr({x}, {at}, 2) between '01' and '{high}', substr({x}, {at}, 2), '01')"
    year, month, day = f"substr({x}, 1, 4)", part(6, 7, 12), part(9, 10, 31)
    return f"if({x} rlike '^[0-9][0-9][0-9][0-9]' and {year} >= '0001', coalesce(try_cast(concat_ws('-', {year}, {month}, {day}) as date), try_cast(concat_ws('-', {year}, {month}, '01') as date)), null)"


#: Functions that statements may call besides the built-in ones: parameters, result and body. A body that names tables needs them among the statement's.
HELPERS: dict[str, tuple[str, str, str, tuple[str, ...]]] = {
    "norm_name": ("name string", "string", f"trim(regexp_replace({_plain('norm_name.name')}, '[^a-z0-9]+', ' '))", ()),
    "norm_title": ("title string", "string", f"trim(regexp_replace(regexp_replace({_plain('norm_title.title')}, {_quoted(text.MARKS)}, ' '), '[^a-z0-9]+', ' '))", ()),
    "fallback_key": (
        "title string, duration_ms int, artists array<string>, track_id string", "string",
        "concat('fb:', substr(sha2(if(norm_title(fallback_key.title) = '' and fallback_key.track_id is not null, concat('id:', fallback_key.track_id), "
        f"concat(norm_title(fallback_key.title), '|', cast(coalesce(fallback_key.duration_ms, 0) div {text.KEY_BUCKET_MS} as string), '|', array_join(coalesce(fallback_key.artists, cast(array() as array<string>)), ','))), 256), 1, {text.KEY_HEX}))", (),
    ),
    "parse_release_date": ("written string", "date", _ragged("parse_release_date.written"), ()),
    "play_completion_ms": ("", "int", str(COMPLETION_MS), ()),
    "mb_genre_list": (
        "kind string, id string", "array<string>",
        "(select if(count(*) = 0, null, transform(array_sort(collect_list(struct(-t.count as votes, t.tag as tag))), x -> x.tag)) from mb_tags t "
        "where t.entity_type = mb_genre_list.kind and t.entity_mbid = mb_genre_list.id and (t.is_genre or t.tag in (select g.name from mb_genres g)))", ("mb_tags", "mb_genres"),
    ),
}


def opened(spark: SparkSession, tables: Mapping[str, DataFrame], names: Iterable[str]) -> tuple[SparkSession, list[str]]:
    """A session that knows the named tables and the helper functions that these suffice for, and the functions' names.

    Each table is one listing of its files, taken now: all statements of the session see the same state of them.
    """
    own, names = spark.newSession(), list(names)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for n in names:
        # A view of another session's table: the frame is rebuilt over the same files.
        view = f"adhoc_{n}_{uuid.uuid4().hex}"
        tables[n].createOrReplaceGlobalTempView(view)
        own.table(f"global_temp.{view}").createOrReplaceTempView(n)
        spark.catalog.dropGlobalTempView(view)
    made = []
    for f, (given, kind, body, needs) in HELPERS.items():
        if set(needs) <= set(names):
            own.sql(f"create temporary function {f}({given}) returns {kind} return {body}")
            made.append(f)
    return own, made


def frame(spark: SparkSession, tables: Mapping[str, DataFrame], names: Iterable[str], statement: str) -> DataFrame:
    """The rows of a statement's last part, lazily, after all parts were checked."""
    names = list(names)
    parts = [s for s in _split(statement) if s.strip()]
    if not parts:
        raise Refused("there is no statement")
    own, made = opened(spark, tables, names)
    for s in parts:
        check(own, s, names, made)
    for s in parts:
        df = own.sql(s)
        check_resolved(own, df)
    return df


@dataclass
class Answer:
    columns: list[tuple[str, str]]
    rows: list[str] = field(default_factory=list)
    more: bool = False


def distinct_names(names: list[str]) -> list[str]:
    """A name that repeats gets _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def run(spark: SparkSession, tables: Mapping[str, DataFrame], names: Iterable[str], statement: str, limit: int = DEFAULT_ROWS, seconds: float = MAX_SECONDS) -> Answer:
    """A statement's first rows as JSON lines, from a session that knows the named tables only.

    Statements parted by semicolons run in turn, the last one's rows are shown. One that takes too long
    is cancelled. Rows come to the driver up to the limit, at most MAX_ROWS and one.
    """
    limit = max(1, min(int(limit), MAX_ROWS))
    df = frame(spark, tables, names, statement)
    kinds = [(n, t) for n, t in zip(distinct_names(df.columns), (t for _, t in df.dtypes))]
    job, context = uuid.uuid4().hex, spark.sparkContext
    timer = threading.Timer(seconds, context.cancelJobsWithTag, [job])
    timer.start()
    context.addJobTag(job)
    try:
        rows = df.toDF(*(n for n, _ in kinds)).limit(limit + 1).toJSON().collect() if kinds else []
    except Exception as e:
        raise TimeoutError(f"it took more than {seconds} seconds; narrow it or aggregate") if not timer.is_alive() else e
    finally:
        context.removeJobTag(job)
        timer.cancel()
    return Answer(kinds, rows[:limit], len(rows) > limit)


def _split(text: str) -> list[str]:
    """Statements between semicolons that stand outside of quotes and comments."""
    out, now, quote, k = [], "", "", 0
    while k < len(text):
        c, two = text[k], text[k : k + 2]
        if quote:
            if c == "\\" and quote in "'\"":
                now += two
                k += 2
                continue
            ends = two == quote if len(quote) == 2 else c == quote
            if ends:
                now += quote
                k += len(quote)
                quote = ""
                continue
        elif two == "--":
            quote = "\n"
        elif two == "/*":
            quote = "*/"
        elif c in "'\"`":
            quote = c
        elif c == ";":
            out.append(now)
            now, k = "", k + 1
            continue
        now += c
        k += 1
    return [*out, now]


#: Counts of tables and when they were taken, by the table's plan over its files.
_COUNTED: dict[int, tuple[float, int]] = {}


def counted(df: DataFrame, seconds: float = COUNT_SECONDS) -> int:
    """The number of rows, counted again only if the last count of the same files is so many seconds old."""
    now, key = time.monotonic(), df.semanticHash()
    for k in [k for k, (at, _) in _COUNTED.items() if now - at > seconds]:
        del _COUNTED[k]
    if key not in _COUNTED:
        _COUNTED[key] = now, df.agg(F.count(F.lit(1))).first()[0]
    return _COUNTED[key][1]


def describe(tables: Mapping[str, DataFrame], names: Iterable[str], counts: bool = True) -> list[dict]:
    """Name, columns and number of rows of each table; see counted()."""
    return [{"table": n, "columns": [{"name": c, "type": t} for c, t in tables[n].dtypes], "rows": counted(tables[n]) if counts else None} for n in names]


def as_text(answer: Answer) -> str:
    """An answer as lines: a header with columns and their types, then a JSON object for each row."""
    head = f"{len(answer.rows)}{'+' if answer.more else ''} row(s)\ncolumns: " + ", ".join(f"{n} {t}" for n, t in answer.columns)
    return "\n".join([head, *(json.dumps(json.loads(r), ensure_ascii=False) for r in answer.rows)])
