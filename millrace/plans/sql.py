"""The read-only SQL gate: one SELECT or WITH over the tables of one namespace, with bound arguments and pages.

Spark's own parser reads the statement. The plan it gives is walked, subqueries included, and every class of plan node and expression in it must be one that is known
here, so what a later Spark adds is refused until it is listed. Relations must be tables of the namespace or names of the statement's own WITH; names and functions that are given
as expressions, paths, several-part names and table functions that read aren't let through. Functions are Spark's built-in ones of the groups that compute on values: none that reaches
the JVM, the session or files, and none that a user has registered. After analysis, each leaf of the plan must be made of literals or be one of the tables that were given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS, MOST_BYTES, MOST_ARGS, MOST_TEXT = 1000, 32 << 20, 100, 1 << 20
#: Groups of built-in functions that compute on values. Fixed values.
GROUPS = set("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs".split())
#: Of other groups, those that read nothing but their arguments; and table functions that read nothing.
ALSO = {"typeof"}
TABLE_FUNCTIONS = set("explode explode_outer inline inline_outer posexplode posexplode_outer range stack".split())
#: Plan nodes of a parsed query. Fixed values.
PLANS = set(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sample Sort SubqueryAlias Union Unpivot "
    "UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition".split()
)
#: Expressions of a parsed query. Fixed values.
EXPRESSIONS = set(
    "Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists First GreaterThan GreaterThanOrEqual "
    "GroupingSets ILike If In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal MultiAlias Multiply NamedParameter Not NotLikeAll NotLikeAny Or Overlay "
    "PosParameter RLike Remainder Rollup ScalarSubquery SemiStructuredExtract SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive "
    "UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace "
    "UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition".split()
)
#: Names that Spark takes for functions of the session where no column is called so. Fixed values.
SESSION_NAMES = {"user", "current_user", "session_user"}
CATALYST = "org.apache.spark.sql.catalyst."
#: Leaves of an analysed plan that read nothing.
MADE = {"LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "UnionLoopRef"}


class QueryError(ValueError):
    pass


@dataclass
class Page:
    rows: list[dict]
    columns: list[str]
    truncated: bool


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.size())]


def _checked(spark: SparkSession, text: str, tables: Mapping[str, DataFrame]) -> None:
    if len(text) > MOST_TEXT:
        raise QueryError(f"a statement has at most {MOST_TEXT} characters")
    if not text.lstrip("( \t\r\n").lower().startswith(("select", "with")):
        raise QueryError("only SELECT and WITH statements are run")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise QueryError(str(e).split("\n\n")[0]) from None
    _Walk(spark, {c.lower() for df in tables.values() for c in df.columns}).plan(plan, {t.lower() for t in tables})


def _named(node) -> str:
    """The simple name of a Catalyst class; the whole name of any other."""
    whole = node.getClass().getName()
    return whole.rpartition(".")[2] if whole.startswith(CATALYST) else whole


class _Walk:
    def __init__(self, spark: SparkSession, columns: set[str]):
        self.refused = SESSION_NAMES - columns
        self.registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier

    def plan(self, node, known: set[str]) -> None:
        name = _named(node)
        if name not in PLANS:
            raise QueryError(f"{name} isn't part of a query")
        if name == "UnresolvedWith":
            known = known | {pair._1().lower() for pair in _seq(node.cteRelations())}
            for pair in _seq(node.cteRelations()):
                self.plan(pair._2(), known)
        elif name == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in known:
                raise QueryError(f"no table {'.'.join(parts)!r} in this namespace")
        elif name == "UnresolvedTableValuedFunction" and ".".join(_seq(node.name())).lower() not in TABLE_FUNCTIONS:
            raise QueryError("this table function isn't allowed")
        for e in _seq(node.expressions()):
            self.expression(e, known)
        for child in _seq(node.children()):
            self.plan(child, known)

    def expression(self, e, known: set[str]) -> None:
        name = _named(e)
        if name not in EXPRESSIONS:
            raise QueryError(f"{name} isn't part of a query's expressions")
        if name == "UnresolvedAttribute" and self.refused and e.name().strip("`").lower() in self.refused:
            raise QueryError(f"{e.name()} isn't a column of these tables")
        if name == "UnresolvedFunction":
            self.function(_seq(e.nameParts()))
        elif name == "UnresolvedGenerator":
            self.function([e.name().unquotedString()])
        elif name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.plan(e.plan(), known)
        elif name == "InSubquery":
            self.plan(e.query().plan(), known)
        for child in _seq(e.children()):
            self.expression(child, known)

    def function(self, parts: list[str]) -> None:
        found = self.registry.lookupFunction(self.identifier(parts[0].lower())) if len(parts) == 1 else None
        if found is None or not found.isDefined() or found.get().getGroup() not in GROUPS and parts[0].lower() not in ALSO:
            raise QueryError(f"function {'.'.join(parts)} isn't allowed")


def _leaves(node) -> list:
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        children = _seq(node.children()) + _seq(node.subqueries()) + (_seq(node.innerChildren()) if _named(node) in ("WithCTE", "CTERelationDef", "UnionLoop") else [])
        children = [c for c in children if hasattr(c, "subqueries")]
        todo += children
        if not children:
            out.append(node)
    return out


def _given(result: DataFrame, tables: Mapping[str, DataFrame]) -> None:
    """Refuses an analysed plan with a leaf that is neither made of literals nor a leaf of one of the tables."""
    known = [x.canonicalized() for df in tables.values() for x in _leaves(df._jdf.queryExecution().analyzed())]
    for leaf in _leaves(result._jdf.queryExecution().analyzed()):
        if _named(leaf) not in MADE and not any(k.equals(leaf.canonicalized()) for k in known):
            raise QueryError("the statement reads something other than the tables of this namespace")


def statement(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: Sequence = ()) -> DataFrame:
    """The statement's result, lazily. Tables are seen by their own names in a session of this statement only; no view is left behind in others."""
    if len(args) > MOST_ARGS:
        raise QueryError(f"at most {MOST_ARGS} arguments")
    text = text.strip().rstrip(";").rstrip()
    _checked(spark, text, tables)
    session = spark.newSession()  # its temporary views are its own
    for conf in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(conf, spark.conf.get(conf))
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in tables.items():
        dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical()).createOrReplaceTempView(f"`{name}`")
    try:
        out = session.sql(text, args=list(args)) if args else session.sql(text)
    except ParseException as e:
        raise QueryError(str(e).split("\n\n")[0]) from None
    _given(out, tables)
    labels = [c.lower() for c in out.columns]
    if twice := sorted({c for c in labels if labels.count(c) > 1}):
        raise QueryError(f"two result columns are called {twice[0]!r}; give them aliases")
    return out


def page(result: DataFrame, limit: int = MOST_ROWS, offset: int = 0) -> Page:
    """At most `limit` rows (1000 at most) from `offset`; whether more follow is found by one row more."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise QueryError(f"limit is 1 to {MOST_ROWS}, offset not negative")
    got = (result.offset(offset) if offset else result).limit(limit + 1).collect()
    rows, size = [], 0
    for r in got[:limit]:
        row = r.asDict(recursive=True)
        if any(isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) for v in row.values()):
            raise QueryError("a result isn't finite")
        size += len(repr(row))
        if size > MOST_BYTES:
            raise QueryError("the page exceeds 32 MiB; ask for fewer rows")
        rows.append(row)
    return Page(rows, result.columns, len(got) > limit)
