"""Cypher to DataFrames. Patterns become equi-joins on keys and everything else column expressions, so that Catalyst plans the whole.

A bound node or relationship is a set of columns named ``<variable>·<property>``; columns that a query does not use are pruned down to the
scan. Types of relationships whose declared ends cannot meet a pattern are dropped while compiling, as are joins to
endpoints that nothing refers to. Choices where the language leaves room: relationships in one MATCH may repeat
(joins, not trails); ascending order puts nulls last and descending order first; an undirected pattern meets a self-loop once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import VECTOR_COLUMNS, Graph, node_id
from ..errors import CypherError, SchemaError
from ..operators.paths import shortest_between, written
from .parser import NodePattern, PathPattern, Projection, RelPattern, check_read_only, parse

#: Levels after which an open ``*`` is given up with an error, unless the caller says otherwise. Nothing is cut silently.
OPEN_HOPS = 30
SEP = "·"
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "stdev", "stdevp", "percentilecont", "percentiledisc"}


@dataclass
class Binding:
    kind: str  # node, rel, value, path
    labels: list[str] = field(default_factory=list)
    props: list[str] = field(default_factory=list)


@dataclass
class Frame:
    df: DataFrame | None
    scope: dict[str, Binding] = field(default_factory=dict)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _visible(props: list[str]) -> list[str]:
    return [p for p in props if p not in VECTOR_COLUMNS]


def _walk(expr: Any):
    if isinstance(expr, tuple):
        yield expr
        for part in expr:
            yield from _walk(part)
    elif isinstance(expr, list):
        for part in expr:
            yield from _walk(part)
    elif isinstance(expr, dict):
        yield from _walk(list(expr.values()))


def has_aggregate(expr: Any) -> bool:
    return any(e and e[0] == "call" and e[1] in AGGREGATES for e in _walk(expr))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "replace": F.replace, "reverse": F.reverse, "left": lambda s, n: F.left(s, n), "right": lambda s, n: F.right(s, n),
    "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E")), F.lit(-1)),
    "substring": lambda s, i, n=None: F.substring(s, i + 1, F.length(s) if n is None else n),
    "tointeger": lambda x: x.try_cast("long"), "tofloat": lambda x: x.try_cast("double"), "tostring": lambda x: x.cast("string"), "toboolean": lambda x: x.try_cast("boolean"),
    "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "round": lambda x, n=None: F.round(x.cast("double"), 0 if n is None else n),
    "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "ln": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "atan2": F.atan2, "pi": F.pi, "e": F.e, "sign": lambda x: F.signum(x).cast("int"), "rand": F.rand, "pow": F.pow, "power": F.pow,
    "date": lambda x=None: F.current_date() if x is None else F.to_date(x), "timestamp": F.to_timestamp, "datetime": lambda x=None: F.current_timestamp() if x is None else F.to_timestamp(x),
    "current_timestamp": F.current_timestamp, "year": F.year, "month": F.month, "day": F.day, "date_part": lambda p, x: F.date_part(p, x), "date_trunc": F.date_trunc, "datediff": F.datediff,
    "coalesce": F.coalesce, "nullif": F.nullif, "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.element_at(x, F.lit(-1)), "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))),
    "range": lambda a, b, s=None: F.sequence(a, b) if s is None else F.sequence(a, b, s), "concat": F.concat, "sha256": lambda x: F.sha2(x, 256), "md5": F.md5,
    "starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains, "list_contains": F.array_contains, "list_sort": F.sort_array, "list_to_string": lambda sep, xs: F.regexp_replace(F.array_join(xs, "\x00"), F.lit("\x00"), sep), "list_distinct": F.array_distinct, "json_extract": F.get_json_object,
}
_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b,
    "^": lambda a, b: F.pow(a.cast("double"), b), "starts": lambda a, b: a.startswith(b), "ends": lambda a, b: a.endswith(b), "contains": lambda a, b: a.contains(b),
    "=~": lambda a, b: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
}
#: The same comparison from its other side.
_TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: Ranges of values in which pairs of a comparison are counted.
RANGES = 64


class Compiler:
    def __init__(self, graph: Graph, params: dict[str, Any] | None = None, procedures: dict[str, Callable[..., DataFrame]] | None = None, open_hops: int = OPEN_HOPS):
        self.graph, self.params, self.fresh, self.open_hops = graph, params or {}, 0, open_hops
        self.procedures = catalog_procedures(graph) | (procedures or {})

    # expressions

    def expr(self, e: Any, scope: dict[str, Binding], local: dict[str, Column] | None = None) -> Column:
        local = local or {}
        go = lambda x: self.expr(x, scope, local)
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise CypherError(f"Parameter ${e[1]} is not given")
            value = self.params[e[1]]
            return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
        if kind == "var":
            return local[e[1]] if e[1] in local else self.variable(e[1], scope)
        if kind == "prop":
            if e[1][0] == "var" and e[1][1] not in local and (b := scope.get(e[1][1])) and b.kind in ("node", "rel"):
                return col(e[1][1] + SEP + e[2]) if e[2] in b.props else F.lit(None).cast("string")
            base = go(e[1])
            return self.date_field(base, e[2]) if e[2] in ("year", "month", "day", "hour", "minute", "second") and e[1][0] == "call" else base[e[2]]
        if kind == "op":
            if e[1] == "+":
                return self.plus(e[2], e[3], scope, local)
            if e[1] == "/":
                a, b = go(e[2]), go(e[3])
                whole = self.integral(e[2], scope) and self.integral(e[3], scope)
                return F.call_function("div", a, b) if whole else a / b
            return _BINARY[e[1]](go(e[2]), go(e[3]))
        if kind == "not":
            return ~go(e[1])
        if kind == "neg":
            return -go(e[1])
        if kind in ("isnull", "notnull"):
            x = self.identity(e[1][1], scope) if e[1][0] == "var" and (b := scope.get(e[1][1])) and b.kind in ("node", "rel") else go(e[1])
            return x.isNull() if kind == "isnull" else x.isNotNull()
        if kind == "in":
            values = self.params.get(e[2][1]) if e[2][0] == "param" else [x[1] for x in e[2][1]] if e[2][0] == "list" and all(x[0] == "lit" for x in e[2][1]) else None
            return go(e[1]).isin(list(values)) if values is not None else F.array_contains(go(e[2]), go(e[1]))
        if kind == "list":
            return F.array(*map(go, e[1]))
        if kind == "map":
            return F.struct(*[go(v).alias(k) for k, v in e[1].items()])
        if kind == "index":
            i = go(e[2])
            return F.get(go(e[1]), F.when(i < 0, F.size(go(e[1])) + i).otherwise(i))
        if kind == "slice":
            base = go(e[1])
            low = F.lit(0) if e[2] is None else go(e[2])
            high = F.size(base) if e[3] is None else go(e[3])
            return F.slice(base, low + 1, F.greatest(high - low, F.lit(0)))
        if kind == "case":
            out = None
            for when, then in e[2]:
                test = go(when) if e[1] is None else go(e[1]) == go(when)
                out = F.when(test, go(then)) if out is None else out.when(test, go(then))
            return out.otherwise(go(e[3]))
        if kind == "comprehension":
            _, var, source, where, mapped = e
            out = go(source)
            if where is not None:
                out = F.filter(out, lambda x: self.expr(where, scope, local | {var: x}))
            return out if mapped is None else F.transform(out, lambda x: self.expr(mapped, scope, local | {var: x}))
        if kind == "quantifier":
            _, how, var, source, where = e
            test = lambda x: self.expr(where, scope, local | {var: x})
            if how == "all":
                return F.forall(go(source), test)
            if how == "single":
                return F.size(F.filter(go(source), test)) == 1
            return F.exists(go(source), test) if how == "any" else ~F.exists(go(source), test)
        if kind == "reduce":
            _, acc, start, var, source, step = e
            return F.aggregate(go(source), go(start), lambda a, x: self.expr(step, scope, local | {acc: a, var: x}))
        if kind == "call":
            return self.call(e, scope, local)
        if kind == "projected":
            return self.projection_of(e, scope, local)
        raise CypherError(f"Unsupported expression {kind}", "EXISTS, COUNT and pattern predicates stand in WHERE, WITH and RETURN, outside comprehensions.")

    def projection_of(self, e: Any, scope: dict, local: dict) -> Column:
        _, subject, items = e
        binding = scope.get(subject[1]) if subject[1] not in local else None
        fields: dict[str, Column] = {}
        for name, value in items:
            if name != "*":
                fields[name] = self.expr(value, scope, local)
            elif binding and binding.kind in ("node", "rel"):
                fields |= {p: col(subject[1] + SEP + p) for p in _visible(binding.props)}
            else:
                raise CypherError(f".* needs a node or a relationship, {subject[1]} is neither")
        whole = F.struct(*[c.alias(n) for n, c in fields.items()])
        return F.when(self.identity(subject[1], scope).isNotNull(), whole) if binding and binding.kind in ("node", "rel") else whole

    def plus(self, a: Any, b: Any, scope: dict, local: dict) -> Column:
        x, y = self.expr(a, scope, local), self.expr(b, scope, local)
        if any(p[0] == "list" for p in (a, b)):
            return F.concat(x, y)
        texts = [self.textual(p, scope) for p in (a, b)]
        return F.concat(x.cast("string"), y.cast("string")) if any(texts) else x + y

    def type_of(self, e: Any, scope: dict) -> str | None:
        if e[0] == "prop" and e[1][0] == "var" and (b := scope.get(e[1][1])) and b.kind in ("node", "rel"):
            for name in b.labels:
                df = self.graph.nodes[name] if b.kind == "node" else self.graph.rels[name]
                if e[2] in df.columns:
                    return df.schema[e[2]].dataType.simpleString()
        return None

    def textual(self, e: Any, scope: dict) -> bool:
        return e[0] == "lit" and isinstance(e[1], str) or e[0] == "param" and isinstance(self.params.get(e[1]), str) or e[0] == "op" and e[1] == "+" and (self.textual(e[2], scope) or self.textual(e[3], scope)) or e[0] == "call" and e[1] in ("toupper", "tolower", "tostring", "substring", "left", "right", "trim", "replace") or self.type_of(e, scope) == "string"

    def integral(self, e: Any, scope: dict) -> bool:
        return e[0] == "lit" and isinstance(e[1], int) or e[0] == "param" and isinstance(self.params.get(e[1]), int) or e[0] == "op" and e[1] in "+-*/%" and self.integral(e[2], scope) and self.integral(e[3], scope) or e[0] == "call" and e[1] in ("count", "size", "length") or self.type_of(e, scope) in ("bigint", "int")

    def date_field(self, base: Column, name: str) -> Column:
        return F.date_part(F.lit(name), base).cast("long")

    def identity(self, var: str, scope: dict[str, Binding]) -> Column:
        return col(var + SEP + ("_id" if scope[var].kind == "node" else "_src"))

    def variable(self, var: str, scope: dict[str, Binding]) -> Column:
        if var not in scope:
            raise CypherError(f"Variable {var} is not defined", f"Defined: {', '.join(scope) or 'none'}")
        b = scope[var]
        if b.kind not in ("node", "rel"):
            return col(var)
        inner = ["_id", "_label"] if b.kind == "node" else ["_type", "_src", "_dst"]
        whole = F.struct(*[col(var + SEP + p).alias(p) for p in [*inner, *_visible(b.props)]])
        return F.when(self.identity(var, scope).isNotNull(), whole)

    def call(self, e: Any, scope: dict[str, Binding], local: dict[str, Column]) -> Column:
        _, name, args, distinct = e
        go = lambda x: self.expr(x, scope, local)
        var = args[0][1] if args and args[0][0] == "var" and args[0][1] in scope and args[0][1] not in local else None
        if name in AGGREGATES:
            x = F.lit(1) if not args else self.identity(var, scope) if var and name == "count" and scope[var].kind in ("node", "rel") else go(args[0])
            if name == "count":
                return F.count_distinct(x) if distinct else F.count(x)
            if name == "collect":
                return F.collect_set(x) if distinct else F.collect_list(x)
            if name in ("sum", "avg"):
                simple = {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg, ("avg", True): lambda c: F.sum_distinct(c) / F.count_distinct(c)}
                return simple[name, distinct](x)
            if name in ("percentilecont", "percentiledisc"):
                how = "percentile_cont" if name.endswith("cont") else "percentile_disc"
                return F.percentile(x, go(args[1])) if how == "percentile_cont" else F.element_at(F.sort_array(F.collect_list(x)), F.greatest(F.ceil(go(args[1]) * F.count(x)).cast("int"), F.lit(1)))
            return {"min": F.min, "max": F.max, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}[name](x)
        if var and scope[var].kind == "node":
            if name == "id":
                return col(var + SEP + "_id")
            if name == "label":
                return col(var + SEP + "_label")
            if name == "labels":
                return F.array(col(var + SEP + "_label"))
            if name in ("keys", "properties"):
                return F.array(*[F.lit(p) for p in _visible(scope[var].props)]) if name == "keys" else F.struct(*[col(var + SEP + p).alias(p) for p in _visible(scope[var].props)])
        if var and scope[var].kind == "rel":
            if name in ("type", "label"):
                return col(var + SEP + "_type")
            if name in ("startnode", "endnode"):
                return col(var + SEP + ("_src" if name == "startnode" else "_dst"))
        if var and scope[var].kind == "counted" and name == "length":
            return col(f"{var}{SEP}hops").cast("long")
        if var and scope[var].kind == "path":
            if name == "length":
                return F.size(col(var)["rels"]).cast("long")
            if name in ("nodes", "rels", "relationships"):
                return col(var)["nodes" if name == "nodes" else "rels"]
        if name in ("size", "length"):
            x = go(args[0])
            return (F.length(x) if self.textual(args[0], scope) else F.size(x)).cast("long")
        if name == "cast":
            kinds = {"int64": "long", "string": "string", "double": "double", "bool": "boolean", "date": "date", "timestamp": "timestamp"}
            return go(args[0]).try_cast(kinds[str(args[1][1]).lower()])
        if name in ("duration", "interval"):
            return F.expr(f"INTERVAL {args[0][1]}")
        if name not in FUNCTIONS:
            raise CypherError(f"Unknown function {name}", f"Known: {', '.join(sorted(FUNCTIONS))}")
        return FUNCTIONS[name](*map(go, args))

    # patterns

    def scan(self, labels: list[str], var: str) -> tuple[DataFrame, Binding]:
        """All nodes of the labels, as columns of ``var``; without labels all visible ones, missing properties null."""
        names = labels or self.graph.visible_labels()
        for label in names:
            if label not in self.graph.nodes:
                raise SchemaError(f"Unknown label {label}", f"Known labels: {', '.join(sorted(self.graph.visible_labels()))}")
        frames, props = [], []
        for label in names:
            df, key = self.graph.nodes[label], self.graph.node_specs[label].key
            frames.append(df.select(node_id(label, df[key]).alias(f"{var}{SEP}_id"), F.lit(label).alias(f"{var}{SEP}_label"), F.col(key).alias(f"{var}{SEP}_key"), *[F.col(f"`{c}`").alias(f"{var}{SEP}{c}") for c in df.columns]))
            props += [c for c in df.columns if c not in props]
        if len(frames) > 1:
            frames = [f.withColumn(f"{var}{SEP}_key", col(f"{var}{SEP}_key").cast("string")) for f in frames]
            kinds = {}
            for f in frames:
                for c, t in f.dtypes:
                    kinds.setdefault(c, set()).add(t)
            mixed = [c for c, t in kinds.items() if len(t) > 1]
            frames = [f.select([col(c).cast("string").alias(c) if c in mixed else col(c) for c in f.columns]) for f in frames]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out, Binding("node", names, props)

    def rel_frame(self, rel: RelPattern, var: str, left: list[str], right: list[str]) -> tuple[DataFrame, Binding, list[str], list[str]]:
        """Relationships from a left to a right node: ``var·_from``, ``var·_to`` are keys (canonical ids if labels vary)."""
        chosen = []
        for name in rel.types or self.graph.visible_rels():
            if name not in self.graph.rels:
                raise SchemaError(f"Unknown relationship type {name}", f"Known types: {', '.join(sorted(self.graph.visible_rels()))}")
            spec = self.graph.rel_specs[name]
            if rel.direction in ("out", "both") and spec.source in left and spec.target in right:
                chosen.append((name, spec.source, spec.target, "_src", "_dst"))
            if rel.direction in ("in", "both") and spec.target in left and spec.source in right:
                chosen.append((name, spec.target, spec.source, "_dst", "_src"))
        if not chosen:
            raise SchemaError(f"No relationship {'|'.join(rel.types) or 'type'} joins {'|'.join(left)} and {'|'.join(right)}")
        froms, tos = list(dict.fromkeys(c[1] for c in chosen)), list(dict.fromkeys(c[2] for c in chosen))
        frames, props = [], []
        for name, a, b, start, end in chosen:
            df, spec = self.graph.rels[name], self.graph.rel_specs[name]
            if start == "_dst" and rel.direction == "both" and spec.source == spec.target:
                df = df.where("_src <> _dst")  # a self-loop meets an undirected pattern once
            own = [c for c in df.columns if c not in ("_src", "_dst")]
            props += [c for c in own if c not in props]
            frames.append(
                df.select(
                    (F.col(start) if len(froms) == 1 else node_id(a, F.col(start))).alias(f"{var}{SEP}_from"),
                    (F.col(end) if len(tos) == 1 else node_id(b, F.col(end))).alias(f"{var}{SEP}_to"),
                    F.lit(name).alias(f"{var}{SEP}_type"),
                    node_id(spec.source, F.col("_src")).alias(f"{var}{SEP}_src"),
                    node_id(spec.target, F.col("_dst")).alias(f"{var}{SEP}_dst"),
                    *[F.col(f"`{c}`").alias(f"{var}{SEP}{c}") for c in own],
                )
            )
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out, Binding("rel", list(dict.fromkeys(c[0] for c in chosen)), props), froms, tos

    def name_for(self, var: str | None) -> str:
        self.fresh += 1
        return var or f"_anon{self.fresh}"

    def filtered(self, frame: Frame, var: str, props: dict[str, Any]) -> None:
        for key, value in props.items():
            frame.df = frame.df.where(self.expr(("prop", ("var", var), key), frame.scope) == self.expr(value, frame.scope))

    def bind_node(self, frame: Frame, node: NodePattern, var: str) -> None:
        if var in frame.scope:
            if frame.scope[var].kind != "node":
                raise CypherError(f"{var} is not a node")
            if node.labels:
                frame.df = frame.df.where(col(f"{var}{SEP}_label").isin(node.labels))
        else:
            df, binding = self.scan(node.labels, var)
            frame.df = df if frame.df is None else frame.df.crossJoin(df)
            frame.scope[var] = binding
        self.filtered(frame, var, node.props)

    def labels_of(self, frame: Frame, node: NodePattern, var: str) -> list[str]:
        return frame.scope[var].labels if var in frame.scope else node.labels or self.graph.visible_labels()

    def key_of(self, frame: Frame, var: str, labels: list[str]) -> Column:
        return col(f"{var}{SEP}_key") if len(labels) == 1 and frame.scope[var].labels == labels else col(f"{var}{SEP}_id")

    def join_hop(self, frame: Frame, left: str, rel: RelPattern, node: NodePattern, var: str) -> None:
        """Extend the frame over one relationship from the bound ``left`` to ``node``."""
        rvar = self.name_for(rel.var)
        right_labels = self.labels_of(frame, node, var)
        rdf, binding, froms, tos = self.rel_frame(rel, rvar, frame.scope[left].labels, right_labels)
        one = len(froms) == 1 and frame.scope[left].labels == froms
        rdf_from = col(f"{rvar}{SEP}_from") if one or len(froms) > 1 else node_id(froms[0], col(f"{rvar}{SEP}_from"))
        here = col(f"{left}{SEP}_key") if one else col(f"{left}{SEP}_id")
        rdf = rdf.withColumn(f"{rvar}{SEP}_from", rdf_from)
        frame.df = frame.df.join(rdf, here == col(f"{rvar}{SEP}_from"))
        frame.scope[rvar] = binding
        self.filtered(frame, rvar, rel.props)
        if var in frame.scope:
            scope = frame.scope[var]
            same = len(tos) == 1 and scope.labels == tos
            target = col(f"{rvar}{SEP}_to") if same or len(tos) > 1 else node_id(tos[0], col(f"{rvar}{SEP}_to"))
            frame.df = frame.df.where((col(f"{var}{SEP}_key") if same else col(f"{var}{SEP}_id")) == target)
            if node.labels:
                frame.df = frame.df.where(col(f"{var}{SEP}_label").isin(node.labels))
        else:
            ndf, nbinding = self.scan(tos, var)
            same = len(tos) == 1
            frame.df = frame.df.join(ndf, col(f"{rvar}{SEP}_to") == (col(f"{var}{SEP}_key") if same else col(f"{var}{SEP}_id")))
            frame.scope[var] = nbinding
        self.filtered(frame, var, node.props)

    def join_hops(self, frame: Frame, left: str, rel: RelPattern, node: NodePattern, var: str, keep_path: bool, shortest: str | None, counted: str | None = None) -> str | None:
        """Extend over lo..hi relationships, level by level from the distinct nodes that the frame has reached.

        Without a path to keep, a level is (start, end, how many walks), summed, so that hubs do not multiply rows; for shortest paths a
        level holds only ends that no level before it has reached from that start. Shortest paths to ends that are known are searched from both ends.
        ``counted`` names a path of which the frame gets only ``hops`` and ``walks``, how many shortest ones there are to an end.
        """
        low, high = rel.hops
        hop = self.name_for(None)
        every = RelPattern(None, rel.types, {}, rel.direction)
        labels = self.graph.visible_labels()
        rdf, binding, froms, tos = self.rel_frame(every, hop, labels, labels)
        for key, value in rel.props.items():
            rdf = rdf.where(col(f"{hop}{SEP}{key}") == self.expr(value, frame.scope))
        # one label all along: keys are joined as they are, else as canonical ids
        plain = froms == tos and len(froms) == 1 and frame.scope[left].labels == froms
        whole = lambda ls, c: c if len(ls) > 1 or plain else node_id(ls[0], c)
        named = lambda c: node_id(froms[0], c) if plain else c
        point = lambda c: F.struct(named(c).alias("_id"), F.substring_index(named(c), ":", 1).alias("_label"))
        edge = F.struct(col(f"{hop}{SEP}_type").alias("_type"), col(f"{hop}{SEP}_src").alias("_src"), col(f"{hop}{SEP}_dst").alias("_dst"))
        edges = rdf.select(whole(froms, col(f"{hop}{SEP}_from")).alias("__from"), whole(tos, col(f"{hop}{SEP}_to")).alias("__to"), *([edge.alias("__edge")] if keep_path else []))
        rels, nodes, end, walks = (f"{hop}{SEP}{x}" for x in ("rels", "nodes", "end", "walks"))
        origin = col(f"{left}{SEP}_key") if plain else col(f"{left}{SEP}_id")
        asked = self.known_ends(frame, node, var, origin, froms, tos, plain, low) if shortest else None
        level = frame.df.select(origin.alias("__start")).distinct().withColumn(end, F.col("__start"))
        if asked:
            found, complete = shortest_between(edges, low, self.open_hops if high is None else high, paths="count" if counted else shortest if keep_path else None, point=point, **asked)
            if high is None and not complete:
                raise CypherError(*self.too_deep())
            found = found.select(F.col("start").alias("__start"), F.col("goal").alias(end), *([F.col("rels").alias(rels), F.col("nodes").alias(nodes)] if keep_path else [F.col(c).alias(f"{counted}{SEP}{c}") for c in ("hops", "walks")] if counted else []))
        else:
            found = self.levels(level, edges, end, rels, nodes, f"{counted}{SEP}walks" if counted else walks, point, rel.hops, keep_path, shortest, counted)
        self.reach(frame, found, origin, end, node, var, froms, tos, plain, named, low)
        if keep_path:
            if rel.var:
                frame.df = frame.df.withColumn(rel.var, col(rels))
                frame.scope[rel.var] = Binding("value")
            return hop
        return None

    def too_deep(self) -> tuple[str, str]:
        return f"A path of open length goes on beyond {self.open_hops} hops", "Give an upper bound, as in *1..5, or a larger open_hops."

    def known_ends(self, frame: Frame, node: NodePattern, var: str, origin: Column, froms: list[str], tos: list[str], plain: bool, low: int) -> dict[str, DataFrame] | None:
        """What is asked of a search from both ends: the pairs, if the last node is bound, or starts and goals, if it is limited by properties; else None."""
        if var in frame.scope:
            if plain and frame.scope[var].labels != froms:
                return None
            goal = col(f"{var}{SEP}_key") if plain else col(f"{var}{SEP}_id")
            within = frame.df.where(col(f"{var}{SEP}_label").isin(node.labels)) if node.labels else frame.df
            return {"pairs": within.select(origin.alias("start"), goal.alias("goal"))}
        if not node.props or any(v[0] not in ("lit", "param") for v in node.props.values()):
            return None
        ndf, binding = self.scan(node.labels or (tos if len(tos) == 1 and (low > 0 or plain) else []), var)
        if plain and binding.labels != froms:
            return None
        ends = Frame(ndf, {var: binding})
        self.filtered(ends, var, node.props)
        return {"starts": frame.df.select(origin.alias("start")), "goals": ends.df.select((col(f"{var}{SEP}_key") if plain else col(f"{var}{SEP}_id")).alias("goal"))}

    def levels(self, level: DataFrame, edges: DataFrame, end: str, rels: str, nodes: str, walks: str, point: Callable[[Column], Column], hops: tuple[int, int | None], keep_path: bool, shortest: str | None, counted: str | None = None) -> DataFrame:
        """Ends within ``hops`` of each start, level by level from the starts."""
        low, high = hops
        reached = lambda df, k: df.withColumn(f"{counted}{SEP}hops", F.lit(k)) if counted else df
        if keep_path:
            level = level.withColumn(rels, F.array().cast("array<struct<_type:string,_src:string,_dst:string>>")).withColumn(nodes, F.array(point(F.col("__start"))))
        elif not shortest or counted:
            level = level.withColumn(walks, F.lit(1).cast("long"))
        found = reached(level, 0) if low == 0 else None
        seen = level.select("__start", end)
        for k in range(1, (self.open_hops if high is None else high) + 1):
            step = level.join(edges, col(end) == F.col("__from"))
            if keep_path:
                step = step.select("__start", F.col("__to").alias(end), F.concat(col(rels), F.array("__edge")).alias(rels), F.concat(col(nodes), F.array(point(F.col("__to")))).alias(nodes))
            elif shortest and not counted:
                step = step.select("__start", F.col("__to").alias(end)).distinct()
            else:
                step = step.groupBy("__start", F.col("__to").alias(end)).agg(F.sum(walks).alias(walks))
            if shortest:
                step = step.join(seen.withColumnRenamed("__start", "__s").withColumnRenamed(end, "__e"), (F.col("__start") == F.col("__s")) & (col(end) == F.col("__e")), "left_anti")
                if keep_path and shortest == "one":
                    step = step.groupBy("__start", end).agg(F.min(F.struct(rels, nodes)).alias("__one")).select("__start", end, F.col(f"__one.`{rels}`").alias(rels), F.col(f"__one.`{nodes}`").alias(nodes))
                seen = seen.union(step.select("__start", end).distinct())
            if high is None:  # how far it goes is not known before
                step = written(step)
                if step.isEmpty():
                    break
            level = step
            if k >= low:
                found = reached(level, k) if found is None else found.unionByName(reached(level, k))
        else:
            if high is None:
                raise CypherError(*self.too_deep())
        if found is None:
            found = reached(level.limit(0), 0)
        if not keep_path and not shortest:
            # one row for each walk
            found = found.select("__start", end, F.explode(F.sequence(F.lit(1).cast("long"), col(walks))).alias("__walk")).drop("__walk")
        return found

    def reach(self, frame: Frame, found: DataFrame, origin: Column, end: str, node: NodePattern, var: str, froms: list[str], tos: list[str], plain: bool, named: Callable[[Column], Column], low: int) -> None:
        """Join the frame with the ends that were found, and those with their nodes."""
        frame.df = frame.df.join(found, origin == F.col("__start")).drop("__start")
        if var in frame.scope:
            here = col(f"{var}{SEP}_key") if plain and frame.scope[var].labels == froms else col(f"{var}{SEP}_id")
            reached = col(end) if not plain or frame.scope[var].labels == froms else named(col(end))
            frame.df = frame.df.where(here == reached)
            if node.labels:
                frame.df = frame.df.where(col(f"{var}{SEP}_label").isin(node.labels))
        else:
            ndf, nbinding = self.scan(node.labels or (tos if len(tos) == 1 and (low > 0 or plain) else []), var)
            same = plain and nbinding.labels == froms
            frame.df = frame.df.join(ndf, (col(end) if same or not plain else named(col(end))) == (col(f"{var}{SEP}_key") if same else col(f"{var}{SEP}_id")))
            frame.scope[var] = nbinding
        self.filtered(frame, var, node.props)
        frame.df = frame.df.drop(end)

    def match(self, frame: Frame, patterns: list[PathPattern]) -> None:
        for path in patterns:
            names = [self.name_for(p.var) if isinstance(p, NodePattern) else None for p in path.parts]
            nodes, rels = path.parts[0::2], path.parts[1::2]
            # a path that begins unbound but ends bound is walked from its end
            if names[0] not in frame.scope and names[-1] in frame.scope and not path.var:
                turned = [RelPattern(r.var, r.types, r.props, {"in": "out", "out": "in", "both": "both"}[r.direction], r.hops) for r in reversed(rels)]
                nodes, rels, vars_ = nodes[::-1], turned, names[0::2][::-1]
            else:
                vars_ = names[0::2]
            if len(nodes) == 2 and self.bare(frame, nodes, vars_, rels[0], path):
                continue
            first = NodePattern(nodes[0].var, nodes[0].labels or self.reachable(nodes, rels, 0), nodes[0].props)
            self.bind_node(frame, first, vars_[0])
            point = lambda v: F.array(F.struct(col(f"{v}{SEP}_id").alias("_id"), col(f"{v}{SEP}_label").alias("_label")))
            parts = [point(vars_[0])]
            edges = []
            alone = path.shortest if len(rels) == 1 else None
            for k, rel in enumerate(rels):
                if rel.hops:
                    hop = self.join_hops(frame, vars_[k], rel, nodes[k + 1], vars_[k + 1], bool(path.var and not path.counted or rel.var), alone, path.var if path.counted else None)
                    if path.var and not path.counted:
                        parts.append(F.slice(col(f"{hop}{SEP}nodes"), F.lit(2), F.size(col(f"{hop}{SEP}rels"))))
                        edges.append(col(f"{hop}{SEP}rels"))
                else:
                    rel.var = rel.var or self.name_for(None)
                    self.join_hop(frame, vars_[k], rel, nodes[k + 1], vars_[k + 1])
                    parts.append(point(vars_[k + 1]))
                    edges.append(F.array(F.struct(*[col(f"{rel.var}{SEP}{c}").alias(c) for c in ("_type", "_src", "_dst")])))
            if path.counted:
                frame.scope |= {path.var: Binding("counted"), f"{path.var}{SEP}walks": Binding("value")}
            elif path.var:
                frame.df = frame.df.withColumn(path.var, F.struct(F.concat(*parts).alias("nodes"), F.concat(*edges).alias("rels")))
                frame.scope[path.var] = Binding("path")
                if path.shortest and not alone:
                    ends = [col(f"{vars_[0]}{SEP}_id"), col(f"{vars_[-1]}{SEP}_id")]
                    best = frame.df.groupBy(*[c.alias(f"__e{k}") for k, c in enumerate(ends)]).agg(F.min(F.struct(F.size(col(path.var)["rels"]).alias("n"), col(path.var).alias("p"))).alias("__best"))
                    rest = frame.df.drop(path.var).dropDuplicates([f"{vars_[0]}{SEP}_id", f"{vars_[-1]}{SEP}_id"])
                    frame.df = rest.join(best, (ends[0] == F.col("__e0")) & (ends[1] == F.col("__e1"))).withColumn(path.var, F.col("__best.p")).drop("__e0", "__e1", "__best")

    def reachable(self, nodes: list[NodePattern], rels: list[RelPattern], k: int) -> list[str]:
        """Labels that an unlabelled node can have, given the types of the relationship beside it."""
        if not rels or rels[k].hops or not rels[k].types:
            return []
        out = []
        for name in rels[k].types:
            if name not in self.graph.rel_specs:
                raise SchemaError(f"Unknown relationship type {name}", f"Known types: {', '.join(sorted(self.graph.visible_rels()))}")
            spec = self.graph.rel_specs[name]
            out += [spec.source] * (rels[k].direction != "in") + [spec.target] * (rels[k].direction != "out")
        return list(dict.fromkeys(out))

    def bare(self, frame: Frame, nodes: list[NodePattern], names: list[str], rel: RelPattern, path: PathPattern) -> bool:
        """``()-[r:T]->()`` with ends that nothing refers to needs no join."""
        if path.var or rel.hops or any(n.var or n.props for n in nodes):
            return False
        labels = [n.labels or self.graph.visible_labels() for n in nodes]
        rvar = self.name_for(rel.var)
        rdf, binding, *_ = self.rel_frame(rel, rvar, *labels)
        frame.df = rdf if frame.df is None else frame.df.crossJoin(rdf)
        frame.scope[rvar] = binding
        self.filtered(frame, rvar, rel.props)
        return True

    # clauses

    def variables(self, patterns: list[PathPattern]) -> list[str]:
        return list(dict.fromkeys(p.var for path in patterns for p in path.parts if isinstance(p, NodePattern) and p.var))

    def sub_frame(self, frame: Frame, patterns: list[PathPattern], where: Any) -> tuple[Frame, list[str]]:
        """A pattern compiled by itself, and the bound node variables that it shares with the frame."""
        shared = [v for v in self.variables(patterns) if v in frame.scope]
        inner = Frame(None, {})
        for path in patterns:
            for part in path.parts:
                if isinstance(part, NodePattern) and part.var in shared and not part.labels:
                    part.labels = frame.scope[part.var].labels
        self.match(inner, patterns)
        if where is not None:
            self.where(inner, where)
        return inner, shared

    def end_of(self, inner: Frame, frame: Frame, var: str) -> str:
        """The column on which two bindings of a variable meet: the key itself where both have the same one label."""
        labels = inner.scope[var].labels
        return "_key" if len(labels) == 1 and frame.scope[var].labels == labels else "_id"

    def on_shared(self, inner: Frame, frame: Frame, shared: list[str], more: list[str] = ()) -> tuple[DataFrame, list[str], list[Column]]:
        """The inner rows with their ends under names of their own, those names, and the conditions that join them to the frame."""
        keys = [f"__k{self.name_for(None)}" for _ in shared]
        ends = [self.end_of(inner, frame, v) for v in shared]
        df = inner.df.select(*[col(f"{v}{SEP}{e}").alias(k) for v, e, k in zip(shared, ends, keys, strict=True)], *map(col, more))
        return df, keys, [col(f"{v}{SEP}{e}") == df[k] for v, e, k in zip(shared, ends, keys, strict=True)]

    def where(self, frame: Frame, condition: Any) -> None:
        """Filters; EXISTS and COUNT subqueries become semi, anti and left joins."""
        if condition[0] == "op" and condition[1] == "and":
            self.where(frame, condition[2])
            self.where(frame, condition[3])
            return
        negated, inner = (True, condition[1]) if condition[0] == "not" else (False, condition)
        if inner[0] == "exists_sub":
            sub, shared = self.sub_frame(frame, inner[1], inner[2])
            keys_df, _, on = self.on_shared(sub, frame, shared)
            frame.df = frame.df.join(keys_df, on, "left_anti" if negated else "left_semi")
            return
        condition = self.subqueries(frame, condition)  # which joins columns to the frame
        frame.df = frame.df.where(self.expr(condition, frame.scope))

    def subqueries(self, frame: Frame, e: Any) -> Any:
        """``e`` with its EXISTS and COUNT subqueries replaced by columns, which left joins of distinct or counted ends bring to the frame."""
        for sub in [x for x in _walk(e) if x and x[0] in ("exists_sub", "count_sub")]:
            inner, shared = self.sub_frame(frame, sub[1], sub[2])
            keys_df, keys, on = self.on_shared(inner, frame, shared)
            name = self.name_for(None)
            counted = keys_df.groupBy(*keys).agg(F.count("*").alias(name))
            on = [F.col(k) == c for k, c in zip(keys, [col(f"{v}{SEP}{self.end_of(inner, frame, v)}") for v in shared], strict=True)]
            joined = frame.df.join(counted, on, "left").drop(*keys) if on else frame.df.crossJoin(F.broadcast(counted))
            frame.df = joined.withColumn(name, F.coalesce(col(name), F.lit(0)))
            frame.scope[name] = Binding("value")
            e = _replace(e, sub, ("var", name) if sub[0] == "count_sub" else ("op", ">", ("var", name), ("lit", 0)))
        return e

    def optional(self, frame: Frame, patterns: list[PathPattern], where: Any) -> None:
        inner, shared = self.sub_frame(frame, patterns, where)
        new = {v: b for v, b in inner.scope.items() if v not in frame.scope}
        columns = [c for c in inner.df.columns if c.split(SEP)[0] in new]
        keys_df, keys, on = self.on_shared(inner, frame, shared, columns)
        frame.df = frame.df.join(keys_df, on, "left").drop(*keys)
        frame.scope |= new

    def project(self, frame: Frame, p: Projection) -> Frame:
        items = [(self.subqueries(frame, i.expr), i.name) for i in p.items]
        if p.star:
            items = [(("var", v), v) for v in frame.scope if not v.startswith("_anon")]
        scope: dict[str, Binding] = {}
        aggregated = any(has_aggregate(e) for e, _ in items)
        columns: list[Column] = []
        keys: list[Column] = []
        for e, name in items:
            binding = frame.scope.get(e[1]) if e[0] == "var" else None
            if binding and binding.kind in ("node", "rel") and not p.final:
                inner = ["_id", "_label", "_key"] if binding.kind == "node" else ["_from", "_to", "_type", "_src", "_dst"]
                kept = [x for x in dict.fromkeys([*inner, *binding.props]) if f"{e[1]}{SEP}{x}" in frame.df.columns]
                these = [col(f"{e[1]}{SEP}{x}").alias(f"{name}{SEP}{x}") for x in kept]
                scope[name] = binding
            else:
                these = [self.expr(e, frame.scope).alias(name)]
                scope[name] = Binding("path" if binding and binding.kind == "path" else "value")
            (columns if has_aggregate(e) or not aggregated else keys).extend(these)
        order, hidden = [], []
        texts = {name: name for _, name in items} | {repr(e): name for e, name in items}
        for k, (e, down, text) in enumerate(p.order):
            name = texts.get(text) or texts.get(repr(e))
            if name and scope[name].kind in ("value", "path"):
                by = col(name)
            elif aggregated or p.distinct:
                by = self.expr(_rename(e, dict(items_by_expr(items))), scope)
            else:
                hidden.append(self.expr(e, frame.scope).alias(f"__o{k}"))
                by = F.col(f"__o{k}")
            order.append(by.desc_nulls_first() if down else by.asc_nulls_last())
        if aggregated:
            df = frame.df.groupBy(*keys).agg(*columns) if keys else frame.df.agg(*columns)
            names = [n for _, n in items]
            df = df.select(*[col(c) for n in names for c in df.columns if c == n or c.startswith(n + SEP)])
        else:
            df = frame.df.select(*columns, *hidden)
        if p.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if p.skip is not None:
            df = df.offset(self.number(p.skip))
        if p.limit is not None:
            df = df.limit(self.number(p.limit))
        out = Frame(df.drop(*[f"__o{k}" for k in range(len(p.order))]) if hidden else df, scope)
        if p.where is not None:
            self.where(out, p.where)
        return out

    def number(self, e: Any) -> int:
        value = e[1] if e[0] == "lit" else self.params.get(e[1]) if e[0] == "param" else None
        if not isinstance(value, int):
            raise CypherError("SKIP and LIMIT take a whole number or a parameter")
        return value

    def counted_pairs(self, clauses: list) -> DataFrame | None:
        """``MATCH p, q WHERE a.x > b.y RETURN keys, count(*)`` without the pairs; None where a query is of another form.

        The path q shares one node with p and has b, p has a and the keys. Of each row of p it is counted how many values y stand before its x, by running sums in order of
        the values, node by node and range by range of values, so that neither a pair is made nor a node of many rows is one task's.
        """
        if len(clauses) != 2 or clauses[0][0] != "match" or clauses[0][1] or clauses[1][0] in ("match", "unwind", "call", "where"):
            return None
        _, _, patterns, where = clauses[0]
        p: Projection = clauses[1][1]
        total = ("call", "count", [], False)
        counts, keys = [i for i in p.items if i.expr == total], [i for i in p.items if i.expr != total]
        if len(patterns) != 2 or where is None or p.star or p.distinct or p.order or p.skip is not None or p.limit is not None or p.where is not None or len(counts) != 1:
            return None
        if where[0] != "op" or where[1] not in _TURNED or any(x[0] != "prop" or x[1][0] != "var" for x in where[2:4]) or any(path.var or path.shortest or any(isinstance(x, RelPattern) and (x.hops or x.var) for x in path.parts) for path in patterns):
            return None
        names = [set(self.variables([path])) for path in patterns]
        shared = names[0] & names[1]
        op, a, b = where[1:4]
        if a[1][1] in names[1]:
            op, a, b = _TURNED[op], b, a
        used = {x[1] for i in keys for x in _walk(i.expr) if len(x) == 2 and x[0] == "var"}
        inner_sub = any(x and x[0] in ("exists_sub", "count_sub") for i in keys for x in _walk(i.expr))
        if len(shared) != 1 or a[1][1] not in names[0] - shared or b[1][1] not in names[1] - shared or not used <= names[0] or inner_sub or any(has_aggregate(i.expr) for i in keys):
            return None
        frame = Frame(None, {})
        self.match(frame, patterns[:1])
        right, ends = self.sub_frame(frame, patterns[1:], None)
        kinds = {self.type_of(a, frame.scope), self.type_of(b, right.scope)}
        if len(kinds) != 1 or kinds & {None, "string", "boolean"}:
            return None
        node = ends[0]
        end = self.end_of(right, frame, node)
        zero = F.lit(0).cast(next(iter(kinds))) if kinds <= {"double", "float"} else None  # one zero, not two
        value = lambda e, scope: self.expr(e, scope) if zero is None else self.expr(e, scope) + zero
        group = [self.expr(i.expr, frame.scope).alias(f"__g{k}") for k, i in enumerate(keys)]
        names_of_group = [f"__g{k}" for k in range(len(keys))]
        mine = frame.df.select(col(f"{node}{SEP}{end}").alias("__node"), value(a, frame.scope).alias("__x"), *group)
        mine = mine.where("__node IS NOT NULL AND __x IS NOT NULL").groupBy("__node", "__x", *names_of_group).agg(F.count("*").alias("__rows"))
        theirs = right.df.select(col(f"{node}{SEP}{end}").alias("__node"), value(b, right.scope).alias("__x")).where("__node IS NOT NULL AND __x IS NOT NULL").groupBy("__node", "__x").agg(F.count("*").alias("__found"))
        before = F.col("__x").asc() if op in (">", ">=") else F.col("__x").desc()
        # of equal values those of q come first where they count
        both = mine.withColumns({"__found": F.lit(0).cast("long"), "__side": F.lit(1)}).unionByName(theirs.withColumns({"__side": F.lit(0 if op in (">=", "<=") else 2)}), allowMissingColumns=True)
        cuts = theirs.groupBy("__node").agg(F.percentile_approx("__x", [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts")).withColumnRenamed("__node", "__of")
        both = both.join(cuts, F.col("__node") == F.col("__of")).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__x")))).drop("__cuts", "__of")
        ranges = both.groupBy("__node", "__range").agg(F.sum("__found").alias("__n"))
        order = F.col("__range").asc() if op in (">", ">=") else F.col("__range").desc()
        whole = F.sum("__n").over(Window.partitionBy("__node").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        ranges = ranges.select(F.col("__node").alias("__of"), F.col("__range").alias("__at"), F.coalesce(whole, F.lit(0)).alias("__whole"))
        running = F.sum("__found").over(Window.partitionBy("__node", "__range").orderBy(before, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counted = both.withColumn("__found", running).where("__side = 1").join(ranges, (F.col("__node") == F.col("__of")) & (F.col("__range") == F.col("__at")))
        number = F.sum(F.col("__rows") * (F.col("__found") + F.col("__whole")))
        if not keys:
            return counted.agg(F.coalesce(number, F.lit(0)).cast("long").alias(counts[0].name))
        out = counted.groupBy(*names_of_group).agg(number.alias("__number")).where("__number > 0")
        column = {id(i): F.col(f"__g{k}") for k, i in enumerate(keys)} | {id(counts[0]): F.col("__number")}
        return out.select(*[column[id(i)].alias(i.name) for i in p.items])

    def counted_paths(self, clauses: list) -> None:
        """Mark the path p of ``MATCH p = allShortestPaths(...) RETURN keys, count(*)`` as counted, where the keys ask of it length(p) only: count(*) becomes the sum of its walks."""
        if len(clauses) != 2 or clauses[0][0] != "match" or clauses[0][1] or clauses[1][0] in ("match", "unwind", "call", "where"):
            return
        _, _, patterns, where = clauses[0]
        p: Projection = clauses[1][1]
        path, total = patterns[0], ("call", "count", [], False)
        counts, keys = [i for i in p.items if i.expr == total], [i for i in p.items if i.expr != total]
        if len(patterns) != 1 or where is not None or path.shortest != "all" or not path.var or len(path.parts) != 3 or not path.parts[1].hops or path.parts[1].var:
            return
        seen = [x for i in keys for x in _walk(i.expr) if x]
        inner = any(x[0] in ("exists_sub", "count_sub") or x[0] == "call" and x[1] in AGGREGATES for x in seen)
        named = {i.name for i in p.items}
        ordered = all(e[0] == "var" and e[1] in named - {path.var} for e, _, _ in p.order)
        if p.star or not counts or not keys or inner or not ordered or seen.count(("var", path.var)) != seen.count(("call", "length", [("var", path.var)], False)):
            return
        path.counted = True
        for i in counts:
            i.expr = ("call", "sum", [("var", f"{path.var}{SEP}walks")], False)

    def single(self, clauses: list) -> DataFrame:
        self.counted_paths(clauses)
        if (df := self.counted_pairs(clauses)) is not None:
            return df
        frame = Frame(None, {})
        for clause in clauses:
            if clause[0] == "match":
                _, optional, patterns, where = clause
                if optional and frame.df is not None:
                    self.optional(frame, patterns, where)
                else:
                    self.match(frame, patterns)
                    if where is not None:
                        self.where(frame, where)
            elif clause[0] == "unwind":
                base = frame.df if frame.df is not None else self.one_row()
                frame.df = base.select("*", F.explode(self.expr(clause[1], frame.scope)).alias(clause[2]))
                frame.scope[clause[2]] = Binding("value")
            elif clause[0] == "call":
                if clause[1] not in self.procedures:
                    raise CypherError(f"Procedure {clause[1]} is not available here")
                value = lambda a: self.params[a[1]] if a[0] == "param" else [x[1] if x[0] == "lit" else -x[1][1] for x in a[1]] if a[0] == "list" else a[1]
                options = {a[1]: value(a[2]) for a in clause[2] if a[0] == "named"}
                frame.df = self.procedures[clause[1]](*[value(a) for a in clause[2] if a[0] != "named"], **options)
                if clause[3]:
                    frame.df = frame.df.select(*[col(c).alias(name) for c, name in clause[3]])
                frame.scope |= {c: Binding("value") for c in frame.df.columns}
            elif clause[0] == "where":
                self.where(frame, clause[1])
            else:
                if frame.df is None:
                    frame.df = self.one_row()
                frame = self.project(frame, clause[1])
        return frame.df

    def one_row(self) -> DataFrame:
        return next(iter(self.graph.nodes.values())).sparkSession.range(1).select()

    def compile(self, text: str) -> DataFrame:
        check_read_only(text)
        out = None
        for every, clauses in parse(text):
            df = self.single(clauses)
            if out is not None:
                df = out.union(df) if every else out.union(df).distinct()
            out = df
        return out


def catalog_procedures(graph: Graph) -> dict[str, Callable[..., DataFrame]]:
    """What CALL can read of the catalog."""
    spark = next(iter(graph.nodes.values())).sparkSession if graph.nodes else None

    def show_tables() -> DataFrame:
        rows = [(n, "NODE") for n in graph.visible_labels()] + [(n, "REL") for n in graph.visible_rels()]
        return spark.createDataFrame(rows, "name string, type string")

    def table_info(name: str) -> DataFrame:
        return spark.createDataFrame(graph.table_info(name), "`property id` int, property_id int, name string, type string, `primary key` boolean, primary_key boolean")

    def setting(name: str) -> DataFrame:
        return spark.createDataFrame([(name, spark.conf.get(name, None))], "name string, value string")

    def version() -> DataFrame:
        return spark.createDataFrame([(spark.version,)], "version string")

    return {"SHOW_TABLES": show_tables, "TABLE_INFO": table_info, "CURRENT_SETTING": setting, "DB_VERSION": version}


def items_by_expr(items: list[tuple[Any, str]]) -> list[tuple[str, str]]:
    return [(repr(e), name) for e, name in items]


def _rename(e: Any, names: dict[str, str]) -> Any:
    if isinstance(e, tuple):
        return ("var", names[repr(e)]) if repr(e) in names else tuple(_rename(x, names) for x in e)
    return [_rename(x, names) for x in e] if isinstance(e, list) else e


def _replace(e: Any, old: Any, new: Any) -> Any:
    if e is old:
        return new
    if isinstance(e, tuple):
        return tuple(_replace(x, old, new) for x in e)
    return [_replace(x, old, new) for x in e] if isinstance(e, list) else e


def cypher(graph: Graph, text: str, params: dict[str, Any] | None = None, procedures: dict[str, Callable[..., DataFrame]] | None = None, open_hops: int = OPEN_HOPS) -> DataFrame:
    """The DataFrame of a read query."""
    return Compiler(graph, params, procedures, open_hops).compile(text)
