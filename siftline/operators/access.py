"""Who may use which namespace and tool, as joins of small tables of rules."""

from __future__ import annotations

import ast
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, NO_KEY, BAD_KEY, NO_NAMESPACE, UNDECLARED, FORBIDDEN = 200, 401, 401, 400, 400, 403


def namespace_allowed(requests: DataFrame, acl: DataFrame) -> DataFrame:
    """Requests (api_key, namespace) whose key has an entry with the namespace or *;
    acl: api_key, namespaces."""
    entries = acl.select("api_key", F.explode("namespaces").alias("_ns"))
    ok = (requests["api_key"] == entries["api_key"]) & ((entries["_ns"] == requests["namespace"]) | (entries["_ns"] == "*"))
    return requests.join(entries, ok, "left_semi")


def check_key(requests: DataFrame, acl: DataFrame) -> DataFrame:
    """requests with ``code`` by the key alone, where no namespace is asked for: no or an
    unknown key 401, else 200.  Without any key all pass."""
    if acl.isEmpty():
        return requests.withColumn("code", F.lit(OK))
    keys = acl.select("api_key", F.lit(True).alias("_known")).distinct()
    return requests.join(keys, "api_key", "left").withColumn("code", F.when(F.col("_known"), OK).otherwise(BAD_KEY)).drop("_known")


def check_requests(requests: DataFrame, acl: DataFrame, declared: list[str]) -> DataFrame:
    """requests with ``code``: no or an unknown key 401, no namespace 400, an undeclared
    one 400, one that the key lacks 403, else 200.  Without any key all pass."""
    if acl.isEmpty():
        return requests.withColumn("code", F.lit(OK))
    keys = acl.groupBy("api_key").agg(F.flatten(F.collect_list("namespaces")).alias("_has"))
    joined = requests.join(keys, "api_key", "left")  # keys are broadcast if they are few
    known = F.col("namespace").isin(declared) if declared else F.lit(True)
    code = (
        F.when(F.col("_has").isNull(), BAD_KEY)
        .when(F.coalesce("namespace", F.lit("")) == "", NO_NAMESPACE)
        .when(~known, UNDECLARED)
        .when(~(F.array_contains("_has", F.col("namespace")) | F.array_contains("_has", "*")), FORBIDDEN)
        .otherwise(OK)
    )
    return joined.withColumn("code", code).drop("_has")


def visible_namespaces(key: str | None, acl: list[tuple[str, list[str]]], declared: list[str]) -> list[str]:
    """What a key sees: all declared without keys or with only *, else its own."""
    if not acl:
        return list(declared)
    own = next((n for k, n in acl if k == key), [])
    return list(declared) if own == ["*"] else list(own)


def matches_tool(patterns: Column, tool: Column) -> Column:
    """An exact name, *, or a start and *; an empty list allows all."""
    fits = F.exists(patterns, lambda p: (p == "*") | (p == tool) | (F.endswith(p, F.lit("*")) & F.startswith(tool, F.regexp_replace(p, r"\*$", ""))))
    return (F.size(patterns) == 0) | fits


def matches_namespace(patterns: Column, namespace: Column) -> Column:
    return (F.size(patterns) == 0) | (F.coalesce(namespace, F.lit("")) == "") | F.exists(patterns, lambda p: (p == "*") | (p == namespace))


class Refused(ValueError):
    """An expression that is no policy."""


#: Operators of policy expressions and what Python calls them.
_OPERATORS = (("&&", " and "), ("||", " or "))
_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def condition(expression: str, payload: Column) -> Column:
    """A policy expression as a null-safe Column over a VARIANT: true, false, or null where
    it can't be evaluated (an absent field, values of kinds that don't compare), which
    ``policy`` passes over.

    Expressions have fields of payload (payload.a.b, payload["a"]), strings, numbers,
    true, false and null, lists, comparisons, ``in``, &&, || and !, has(payload.a),
    size(x), and x.startsWith(s), endsWith(s), contains(s), matches(regex).  && and || are
    decided by one side where that is enough, whatever the other is."""
    quoted = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'')

    def plain(text: str) -> str:
        for mine, python in _OPERATORS:
            text = text.replace(mine, python)
        return re.sub(r"!(?!=)", " not ", text)

    out, at = [], 0
    for m in quoted.finditer(expression):
        out += [plain(expression[at : m.start()]), m[0]]
        at = m.end()
    try:
        tree = ast.parse("".join([*out, plain(expression[at:])]).strip(), mode="eval").body
    except SyntaxError as e:
        raise Refused(f"not a policy expression: {expression!r}") from e
    return _truth(tree, payload)


def _path(node: ast.expr) -> str | None:
    """payload.a["b"] as a path, or None if the node is no field."""
    if isinstance(node, ast.Name) and node.id == "payload":
        return "$"
    name = node.attr if isinstance(node, ast.Attribute) else node.slice.value if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) else None
    base = _path(node.value) if name is not None else None
    if base is None:
        return None
    return f"{base}[{name}]" if isinstance(name, int) else f"{base}['{_safe(name)}']"


def _safe(name: object) -> str:
    if not isinstance(name, str) or "'" in name or "\\" in name:
        raise Refused(f"not a field name: {name!r}")
    return name


def _constant(node: ast.expr) -> object:
    if isinstance(node, ast.Name) and node.id in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[node.id]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return -node.operand.value
    if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float)):
        return node.value
    raise Refused(f"not a value: {ast.unparse(node)}")


def _kind(payload: Column, path: str) -> Column:
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(payload, path, "variant")), r"^\w+", 0)


#: Kinds of a variant, by what they compare with.
_KINDS = {str: ("STRING",), bool: ("BOOLEAN",), float: ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")}


def _typed(payload: Column, node: ast.expr, kind: type) -> Column:
    """A field or a constant as a kind; null if it is another."""
    path = _path(node)
    if path is None:
        if isinstance(node, ast.Call) and _called(node) == "size":
            return _size(payload, node).cast("double") if kind is float else F.lit(None)
        value = _constant(node)
        is_kind = type(value) is kind or (kind is float and type(value) in (int, float))
        return F.lit(value if is_kind else None).cast({str: "string", bool: "boolean", float: "double"}[kind])
    value = F.try_variant_get(payload, path, {str: "string", bool: "boolean", float: "double"}[kind])
    return F.when(_kind(payload, path).isin(*_KINDS[kind]), value)


def _called(node: ast.Call) -> str:
    return node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""


def _size(payload: Column, node: ast.Call) -> Column:
    path = _path(node.args[0]) if node.args else None
    if path is None:
        raise Refused(f"size() of what: {ast.unparse(node)}")
    text = F.length(_typed(payload, node.args[0], str))
    return F.coalesce(F.size(F.when(_kind(payload, path) == "ARRAY", F.try_variant_get(payload, path, "array<variant>"))), text)


def _compare(op: str, a: ast.expr, b: ast.expr, payload: Column) -> Column:
    """Values of one kind; == of two kinds is false, as that of null and a value."""
    sides = []
    for kind in (str, bool, float):
        x, y = _typed(payload, a, kind), _typed(payload, b, kind)
        sides.append({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
    same = F.coalesce(*sides)
    if op not in ("==", "!="):
        return same
    there = F.lit(True)
    for side in (a, b):
        if (path := _path(side)) is not None:
            there = there & F.try_variant_get(payload, path, "variant").isNotNull()
        elif isinstance(side, ast.Call):
            there = there & _size(payload, side).isNotNull()
    nulls = [_path(s) for s in (a, b)]
    if any(p is None and not isinstance(s, ast.Call) and _constant(s) is None for p, s in zip(nulls, (a, b), strict=True)):
        path = next((p for p in nulls if p), None)
        equal = F.is_variant_null(F.try_variant_get(payload, path, "variant")) if path else F.lit(True)
        return F.when(there, equal if op == "==" else ~equal)
    return F.when(there, F.coalesce(same, F.lit(op == "!=")))


def _truth(node: ast.expr, payload: Column) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, payload) for v in node.values]
        out = parts[0]
        for p in parts[1:]:  # SQL's and, or decide by one side where they can
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, payload)
    if isinstance(node, ast.Compare):
        parts = []
        for a, op, b in zip([node.left, *node.comparators], node.ops, node.comparators, strict=False):
            parts.append(_in(a, b, payload) if isinstance(op, ast.In) else _compare(_COMPARE[type(op)], a, b, payload) if type(op) in _COMPARE else None)
        if any(p is None for p in parts) or len(parts) > 1:
            raise Refused(f"not a comparison: {ast.unparse(node)}")
        return parts[0]
    if isinstance(node, ast.Call):
        return _call(node, payload)
    if _path(node) is not None:
        return _typed(payload, node, bool)
    return F.lit(_constant(node)).cast("boolean") if isinstance(_constant(node), bool) else F.lit(None).cast("boolean")


def _in(a: ast.expr, b: ast.expr, payload: Column) -> Column:
    """A value in a list of values, in a list field, or as a name of an object."""
    if isinstance(b, ast.List):
        found = [_compare("==", a, x, payload) for x in b.elts]
        return F.coalesce(*[F.when(f, True) for f in found], *found) if found else F.lit(False)
    path = _path(b)
    if path is None or _path(a) is not None and _path(a) == "$":
        raise Refused("in needs a list or a field")
    inside = F.when(_kind(payload, path) == "ARRAY", F.try_variant_get(payload, path, "array<variant>"))
    hits = [_holds(inside, _typed(payload, a, kind), kind) for kind in (str, bool, float)]
    of_list = F.coalesce(*hits)
    if not isinstance(a, ast.Constant):
        return of_list
    named = F.try_variant_get(payload, f"{path}['{_safe(a.value)}']", "variant").isNotNull() if isinstance(a.value, str) else F.lit(False)
    return F.coalesce(of_list, F.when(_kind(payload, path) == "OBJECT", named))


def _holds(values: Column, value: Column, kind: type) -> Column:
    """Whether a list of variants holds a value of a kind; null for a null value."""
    name = {str: "string", bool: "boolean", float: "double"}[kind]

    def fits(x: Column) -> Column:
        alike = F.regexp_extract(F.schema_of_variant(x), r"^\w+", 0).isin(*_KINDS[kind])
        return F.coalesce(alike & (F.try_variant_get(x, "$", name) == value), F.lit(False))

    return F.when(value.isNotNull(), F.exists(values, fits))


def _call(node: ast.Call, payload: Column) -> Column:
    name = _called(node)
    if name == "has" and len(node.args) == 1 and isinstance(node.args[0], ast.Attribute) and (path := _path(node.args[0])):
        # what the field lies in must be there
        holder = F.try_variant_get(payload, _path(node.args[0].value) or "$", "variant").isNotNull()
        return F.when(holder, F.try_variant_get(payload, path, "variant").isNotNull())
    if isinstance(node.func, ast.Attribute) and len(node.args) == 1:
        of, with_ = _typed(payload, node.func.value, str), _typed(payload, node.args[0], str)
        if name in ("startsWith", "endsWith", "contains"):
            return {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains}[name](of, with_)
        if name == "matches":
            return F.regexp(of, with_)
    raise Refused(f"not a function: {ast.unparse(node)}")


def policy(requests: DataFrame, rules: list[tuple[str, list[str], list[str]]], payload: str = "payload", out: str = "allowed") -> DataFrame:
    """requests (tool, namespace and a token's payload as JSON text or VARIANT) with
    ``out``.  The first rule whose expression is true decides, by tool and namespace; one
    that can't be evaluated is passed over.  None is true: denied.  No rules: allowed.  No
    payload, or one that is no JSON: denied.  An expression that is no policy is an error
    when the plan is made."""
    if not rules:
        return requests.withColumn(out, F.lit(True))
    given = F.col(payload)
    if dict(requests.dtypes)[payload] != "variant":
        given = F.try_parse_json(given)
    verdict = F.lit(False)
    for expression, tools, namespaces in reversed(rules):
        lists = [F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in (tools, namespaces)]
        passes = matches_tool(lists[0], F.col("tool")) & matches_namespace(lists[1], F.col("namespace"))
        verdict = F.when(F.coalesce(condition(expression, F.col("_claims")), F.lit(False)), passes).otherwise(verdict)
    return requests.withColumn("_claims", given).withColumn(out, F.col("_claims").isNotNull() & verdict).drop("_claims")


def tool_policy(requests: DataFrame, rules: list[tuple[str, list[str], list[str]]], key: str = "request_id") -> DataFrame:
    """requests with ``allowed``, by conditions over columns (see ``policy`` for those over a
    token's payload).  rules: (SQL condition over the request, tools,
    namespaces) in order; the first whose condition holds decides, by tool and
    namespace; a condition that fails to evaluate is passed over; none holds: denied;
    no rules: allowed."""
    if not rules:
        return requests.withColumn("allowed", F.lit(True))
    conf = requests.sparkSession.conf
    ansi = conf.get("spark.sql.ansi.enabled")
    # expressions keep the mode they are resolved in: here, what fails is null and not an error
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        verdict = F.lit(False)
        for condition, tools, namespaces in reversed(rules):
            if not _resolves(requests, condition):
                continue
            lists = [F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in (tools, namespaces)]
            passes = matches_tool(lists[0], F.col("tool")) & matches_namespace(lists[1], F.col("namespace"))
            verdict = F.when(F.coalesce(F.expr(condition), F.lit(False)), passes).otherwise(verdict)
        return requests.withColumn("allowed", verdict)
    finally:
        conf.set("spark.sql.ansi.enabled", ansi)


def _resolves(requests: DataFrame, condition: str) -> bool:
    """False if a condition names a column that the requests don't have."""
    try:
        return bool(requests.select(F.expr(condition)).columns)
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            return False
        raise


def resolve(argument: Column, forwarded: Column, default: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(F.nullif(argument, F.lit("")), F.nullif(forwarded, F.lit("")), default, F.lit(""))
