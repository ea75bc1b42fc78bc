"""Multi-grain summaries: one Expand and one aggregate for all grouping sets."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, NumericType, StructField, StructType

from ..errors import MarginError
from ..functions.context import Deferred
from ..functions.selections import Across, Selected, ShareAcross, quoted
from ..functions.shares import Share
from ..plans.plan import GroupingPlan
from .prepare import Operation, by_set, expanded, prepare, set_bits

#: Columns that Spark's grouping sets take at most.
NATIVE_COLUMNS = 64
#: Dimensions up to which a set is looked up by its bits in an array.
DENSE = 10
#: Copies of a grand total among which the rows that refer to it are dealt.
SALTS = 256
#: Plan nodes below which a look for one row reads one piece of one input.
_CHEAP = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "Range", "View", "DataSourceV2Relation", "OneRowRelation"}
#: Option names that a summary's keyword must not nearly spell.
OPTIONS = ("grouping", "margin_label", "margin_label_position", "check_margin_label", "check_share_source", "duplicates", "method")


def _near(a: str, b: str) -> bool:
    """Whether one change of a letter turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + (len(a) >= len(b)) :] == b[at + (len(b) >= len(a)) :]


def _summaries(op: Operation, given: tuple, named: dict) -> list[tuple[str, Column | Deferred | Share]]:
    """Names and values in order; a name that is None stands for a struct whose fields are the results."""
    hidden = (*op.plan.by, *op.plan.dims)
    for n in named:
        if near := [o for o in OPTIONS if _near(n.lower(), o)]:
            raise MarginError(f"`{n}` is no option; is `{near[0]}` meant? A summary of that name goes into a dict.")
    out: list[tuple] = []

    def one(name: str, value):
        if isinstance(value, ShareAcross):
            raise MarginError(f"`{name}`: `share_across()` names its own results; pass it without a name.")
        if isinstance(value, Across):
            return F.struct(*[v.alias(n) for n, v in value.named(op.df.schema, hidden)])
        return value.resolve(op.df.schema, hidden) if isinstance(value, Selected) else value

    for g in (*given, named):
        if isinstance(g, Across):
            out += g.named(op.df.schema, hidden)
        elif isinstance(g, ShareAcross):
            earlier = [n for n, v in out if n is not None and not isinstance(v, Share)]
            out += g.named(StructType([StructField(n, NullType()) for n in earlier]))
        elif isinstance(g, dict):
            out += [(n, one(n, v)) for n, v in g.items()]
        elif isinstance(g, (Column, Selected)) and not isinstance(g, Deferred):
            out.append((None, one("a struct", g)))
        else:
            raise MarginError(f"Summaries are dicts, `across()`, `share_across()` or structs, not {type(g).__name__}.")
    for n, v in out:
        if not isinstance(v, (Column, Share)):
            raise MarginError(f"Summary `{n}` must be a Column, a grouping helper or a share, not {type(v).__name__}.")
        asked = v.columns if isinstance(v, Deferred) else re.findall(r"grouping\(`?((?:[^()`]|``)*)`?\)", v._jc.toString()) if isinstance(v, Column) else ()
        known = {h.lower() for h in hidden}
        if unknown := [c for c in asked if c.replace("``", "`").lower() not in known]:
            raise MarginError(f"`{n}` asks for the grouping of `{unknown[0]}`, which is no grouping column.")
    return out


def _uses(value: Column, name: str) -> bool:
    return re.search(rf"(?<![\w`.]){re.escape(name)}(?![\w`(])", value._jc.toString()) is not None


def _check_shares(op: Operation, items: list[tuple], grouping) -> None:
    shares = [(n, v) for n, v in items if isinstance(v, Share)]
    seen: dict[str, object] = {}
    for n, v in items:
        if isinstance(v, Share):
            if v.source not in seen:
                raise MarginError(f"`{n}` needs an earlier summary `{v.source}`.")
            source = seen[v.source]
            if isinstance(source, Share):
                raise MarginError(f"`{n}` can't take the share of a share.")
            own = {c.lower() for c in op.df.columns}
            if other := [e for e in seen if e and e.lower() not in own and e != v.source and not isinstance(source, Deferred) and _uses(source, e)]:
                raise MarginError(f"`{n}`: its source `{v.source}` is built on the summary `{other[0]}`; a share's source stands on the data alone.")
        seen[n] = v
    if any(v.kind == "parent" for _, v in shares) and (grouping is None or grouping.kind != "rollup"):
        raise MarginError("`share_of_parent()` needs a single `rollup()`.")
    if any(v.kind == "total" for _, v in shares) and not op.plan.has_total:
        raise MarginError("`share_of_total()` needs the grand total among the grouping sets.")


def _id_of(plan: GroupingPlan, mask: str) -> str:
    """SQL for the first id of the set whose grouping bits, read as a number, are ``mask``."""
    first = {sum(b << k for k, b in enumerate(reversed(m))): o[0] for m, o in plan.distinct.items()}
    if len(first) == 1:
        return str(next(iter(first.values())))
    if len(plan.dims) <= DENSE:
        return f"get(array({', '.join(str(first.get(m, 'null')) for m in range(1 << len(plan.dims)))}), cast({mask} as int))"
    signed = {m - (1 << 64) if m >> 63 else m: i for m, i in first.items()}
    return f"element_at(map({', '.join(f'{m + 1}L - 1L, {i}' if m < 0 else f'{m}L, {i}' for m, i in signed.items())}), {mask})"


def _aggregate(op: Operation, items: list[tuple[str, Column | Deferred]], method: str) -> tuple[DataFrame, dict[str, str], dict[str, str], tuple[str, bool]]:
    """Aggregated rows, one for each group of each distinct set, then repeated for its occurrences; bits and the set's id as SQL."""
    plan, df = op.plan, op.df
    canon = {c.lower(): c for c in (*plan.by, *plan.dims)}

    def resolved(bit) -> list[Column]:
        of = lambda c: F.lit(0) if canon[c.lower()] in plan.by else bit(canon[c.lower()])
        return [(v.resolve(of) if isinstance(v, Deferred) else v).alias(n) for n, v in items]

    spare = [F.expr(f"count(1) as {op.names.new('rows')}")]
    inner = [n for n, v in items if not isinstance(v, Deferred) and "grouping(" in v._jc.toString()]  # helpers inside other expressions
    explode = method == "explode" or len(plan.by) + len(plan.dims) > NATIVE_COLUMNS
    if inner and (explode or not plan.by and not plan.dims):
        raise MarginError(f"`{inner[0]}`: here a grouping helper must stand alone or in arithmetic.")
    if explode:
        rows, keys, mark = expanded(op, distinct=True)
        bits, first, top = set_bits(op, mark), mark, plan.sets.index(()) + 1 if plan.has_total else None
        out = rows.groupBy(F.col(mark), *[F.col(quoted(keys[c])) for c in (*plan.by, *plan.dims)]).agg(*spare, *resolved(lambda d: F.max(F.expr(bits[d]))))
    else:
        keys, mark = {c: c for c in (*plan.by, *plan.dims)}, op.names.new("mask")
        columns = [F.col(quoted(c)) for c in (*plan.by, *plan.dims)]
        top = -1 if len(plan.dims) == NATIVE_COLUMNS else (1 << len(plan.dims)) - 1
        bits = {d: f"cast(shiftright({mark}, {len(plan.dims) - 1 - k}) & 1 as int)" for k, d in enumerate(plan.dims)}
        first = _id_of(plan, mark)
        if not columns:
            out = df.agg(*spare, *resolved(lambda d: F.lit(1)), F.expr(f"0L as {mark}"))
        elif not plan.dims and not inner:
            out = df.groupBy(*columns).agg(*spare, *resolved(lambda d: F.lit(1)), F.expr(f"0L as {mark}"))
        else:
            sets = [[F.col(quoted(c)) for c in (*plan.by, *plan.sets[i[0] - 1])] for i in plan.distinct.values()]
            out = df.groupingSets(sets, *columns).agg(*spare, *resolved(F.grouping), F.expr(f"cast(grouping_id() as bigint) as {mark}"))
    if plan.has_total and not plan.by and plan.dims and not df.isStreaming and not inner:
        # grouping sets give no grand total for no rows; an aggregate of nothing does
        nothing = df.where("false").agg(*spare, *resolved(lambda d: F.lit(1)), F.expr(f"{top}{'' if explode else 'L'} as {mark}"))
        out = _or_nothing(op, out, nothing, f"{mark} = {top}", [keys[d] for d in plan.dims])
    return out, keys, bits, (first, bool(op.id or op.sort != "none" or any(len(o) > 1 for o in plan.distinct.values())))


def _numeric(rows: DataFrame, name: str, source: str) -> None:
    kind = rows.schema[source].dataType
    if not isinstance(kind, NumericType):
        raise MarginError(f"`{name}` needs a numeric summary; `{source}` is {kind.simpleString()}.")


def _listed(ids: list[int]) -> str:
    return ", ".join(map(str, ids))


def _with_shares(op: Operation, rows: DataFrame, keys: dict[str, str], set_name: str, shares: list[tuple[str, Share]]) -> DataFrame:
    """One window per kind over the aggregated rows, so that they are computed once.

    A row that others refer to is repeated as a target; the window over (target set, ``by``, the target's
    dimensions) hands its value to them, null keys being equal. Without ``by`` the grand total is
    repeated SALTS times, and what refers to it is dealt among them.
    """
    plan, columns = op.plan, [quoted(c) for c in rows.columns]
    for kind in ("parent", "total"):
        wanted = [(n, s) for n, s in shares if s.kind == kind]
        if not wanted:
            continue
        targets = plan.parent_targets() if kind == "parent" else plan.total_targets()
        children = {i: t for i, t in targets.items() if t is not None}
        own = [i for i, t in targets.items() if t is None]
        if not children:
            rows = rows.select("*", *[F.expr(f"1D as {quoted(n)}") for n, _ in wanted])
            columns += [quoted(n) for n, _ in wanted]
            continue
        role, target = op.names.new("role"), by_set(set_name, {i: children.get(i, 0) for i in plan.ids})
        referred = sorted(set(children.values()))
        spread = [t for t in referred if not plan.by and not plan.sets[t - 1]]
        hashed = f"cast(pmod(xxhash64({', '.join([set_name, *[quoted(keys[c]) for c in (*plan.by, *plan.dims)]])}), {SALTS}) as int)"
        entry = lambda is_target, of, salt: f"named_struct('target', {is_target}, 'of', {of}, 'salt', {salt})"
        as_child = f"array({entry('false', target, f'if({target} in ({_listed([0, *spread])}), {hashed}, 0)')})"
        roles = as_child
        if plain := [t for t in referred if t not in spread]:
            roles = f"if({set_name} in ({_listed(plain)}), concat({as_child}, array({entry('true', set_name, 0)})), {roles})"
        if spread:
            repeated = f"transform(sequence(0, {SALTS - 1}), salt -> {entry('true', set_name, 'salt')})"
            roles = f"if({set_name} in ({_listed(spread)}), concat({as_child}, {repeated}), {roles})"
        rows = rows.select("*", F.expr(f"explode({roles}) as {role}"))
        parts = [f"{role}.of", f"{role}.salt", *[quoted(keys[b]) for b in plan.by]]
        if kind == "parent":
            for d in plan.dims:
                if inside := [t for t in referred if d in plan.sets[t - 1]]:
                    parts.append(f"if({role}.of in ({_listed(inside)}), {quoted(keys[d])}, null)")
        dens = {s: op.names.new(f"of_{kind}_{k}") for k, s in enumerate(dict.fromkeys(s.source for _, s in wanted))}
        over = f"over (partition by {', '.join(parts)})"
        rows = rows.select("*", *[F.expr(f"max(if({role}.target, cast({quoted(s)} as double), null)) {over} as {den}") for s, den in dens.items()]).where(f"not {role}.target")
        ratios = []
        for n, s in wanted:
            top, den = f"cast({quoted(s.source)} as double)", dens[s.source]
            ratio = f"if({top} is null or isnan({top}) or {den} is null or isnan({den}) or {den} = 0, null, {top} / {den})"
            ratios.append(F.expr((f"if({set_name} in ({_listed(own)}), 1D, {ratio})" if own else ratio) + f" as {quoted(n)}"))
        rows = rows.select(*columns, *ratios)
        columns += [quoted(n) for n, _ in wanted]
    return rows


def _reads_only(df: DataFrame) -> bool:
    """Whether looking for one row is cheap: a scan without joins, aggregates or sorts."""
    def cheap(node) -> bool:
        name = node.getClass().getSimpleName()
        kids = node.children()
        return name in _CHEAP and kids.size() <= 1 and all(cheap(kids.apply(k)) for k in range(kids.size()))

    try:
        return cheap(df._jdf.queryExecution().analyzed())
    except Exception:  # no plan at hand (a remote session)
        return False


def _or_nothing(op: Operation, out: DataFrame, nothing: DataFrame, total: str, keys: list[str]) -> DataFrame:
    """``out``, or ``nothing`` (one row, without keys) if the data have no row.

    Over a plain scan a look for one row decides; else the grand total's own presence does, so that
    nothing below the aggregate runs twice.
    """
    if _reads_only(op.df):
        found = op.df.select(F.expr(f"1 as {op.names.new('any')}")).limit(1)
        return out.unionByName(nothing.join(found, F.lit(True), "left_anti"), allowMissingColumns=True)
    spare, slot = op.names.new("spare"), op.names.new("slot")
    both = out.select("*", F.expr(f"false as {spare}")).unionByName(nothing.select("*", F.expr(f"true as {spare}")), allowMissingColumns=True)
    dealt = f"cast(pmod(xxhash64({', '.join(quoted(k) for k in keys)}), {SALTS}) as int) + 1"
    both = both.select("*", F.expr(f"if({spare} or {total}, 0, {dealt}) as {slot}"))
    found = f"max(if(not {spare} and {slot} = 0, 1, null)) over (partition by {slot})"
    return both.withColumn(slot, F.expr(found)).where(f"not {spare} or {slot} is null").drop(spare, slot)


def summarize_with_margins(df: DataFrame, *summaries, by=None, grouping=None, margin_label="Total", margin_label_position: str = "last", check_margin_label: bool = False,
                           check_share_source: bool = True, duplicates: str = "error", id: str | None = None, sort: str = "none", method: str = "native", **named) -> DataFrame:
    """Aggregate at every grouping set; fixed keys, dimensions, ``id``, then the summaries as written.

    Summaries are given as dicts, ``across()``, ``share_across()`` or keywords; a struct without a
    name gives one result for each field. Grouping helpers may stand inside any expression; alone or
    in arithmetic they also work with "explode" and in the grand total of data without rows, which
    is left out if one stands deeper. Dimensions left
    out show their label. No job runs unless ``check_margin_label`` asks for one. Data without
    rows give one grand total if that is a set and there is no ``by``. ``method="explode"``
    expands rows before the aggregate instead of using grouping sets (always beyond 64 columns).
    """
    if method not in ("native", "explode"):
        raise MarginError("`method` must be 'native' or 'explode'.")
    if not isinstance(check_share_source, bool):
        raise MarginError("`check_share_source` must be True or False.")
    op = prepare(df, by, grouping, margin_label, margin_label_position, check_margin_label, duplicates, id, sort)
    items = _summaries(op, summaries, named)
    op.check_outputs([n for n, _ in items if n is not None])
    packed = {}
    for k, (n, v) in enumerate(items):
        if n is None:
            items[k] = (op.names.new("struct"), v)
            packed[items[k][0]] = None
    _check_shares(op, items, grouping)
    op.check_labels()
    plain = [(n, v) for n, v in items if not isinstance(v, Share)]
    shares = [(n, v) for n, v in items if isinstance(v, Share)]
    for n, _ in items:
        op.names.taken.add(n.lower())
    if op.id:
        op.names.taken.add(op.id.lower())
    try:
        rows, keys, bits, (first, needed) = _aggregate(op, plain, method)
    except AnalysisException as e:
        if taken := [n for n, _ in shares if f"`{n}`" in str(e).partition("Did you mean")[0]]:
            raise MarginError(f"A summary can't use the share `{taken[0]}`; shares come last.") from e
        raise
    for name in packed:
        kind = rows.schema[name].dataType
        if not isinstance(kind, StructType):
            raise MarginError("A summary without a name must be a struct, whose fields become results.")
        packed[name] = kind.names
    outputs = [x for n, _ in items for x in (packed[n] if n in packed else [n])]
    if packed:
        op.check_outputs(outputs)
        rows = rows.withColumns({f: F.col(quoted(n)).getField(f) for n, fields in packed.items() for f in fields}).drop(*packed)
    set_id = None
    if needed or shares:
        set_name = op.names.new("id")
        occurrences = {o[0]: o for o in op.plan.distinct.values()}
        if any(len(o) > 1 for o in occurrences.values()):
            each = ", ".join(f"cast(array({_listed(occurrences.get(i, []))}) as array<int>)" for i in op.plan.ids)
            rows = rows.select("*", F.expr(f"explode(get(array({each}), {first} - 1)) as {set_name}"))
        else:
            rows = rows.select("*", F.expr(f"{first} as {set_name}"))
        set_id = set_name
        if shares:
            if check_share_source:
                for n, s in shares:
                    _numeric(rows, n, s.source)
            rows = _with_shares(op, rows, keys, set_name, shares)
    return op.finish(rows, keys, bits, set_id, outputs)


summarise_with_margins = summarize_with_margins
