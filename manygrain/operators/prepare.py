"""What all verbs share: options, plan, labels, result order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MarginError
from ..functions.selections import quoted
from ..names import Names
from ..plans.labels import check_declared, check_observed, labelled, levels_of, new_metadata, resolve_labels
from ..plans.plan import POLICIES, GroupingPlan, compile_plan


@dataclass
class Operation:
    df: DataFrame
    plan: GroupingPlan
    labels: dict[str, object]
    position: str
    check: bool
    id: str | None
    sort: str
    names: Names

    def check_labels(self) -> None:
        check_declared(self.df.schema, self.labels)
        if self.check:
            check_observed(self.df, self.labels)

    def check_outputs(self, outputs: list[str]) -> None:
        keys = {k.lower() for k in (*self.plan.by, *self.plan.dims)}
        seen: set[str] = set()
        for name in outputs:
            if not isinstance(name, str) or not name:
                raise MarginError("Summaries need non-empty names.")
            if name.lower() in keys:
                raise MarginError(f"`{name}` is a grouping column; a result can't replace it.")
            if name.lower() in seen:
                raise MarginError(f"`{name}` names two results.")
            if self.id and name.lower() == self.id.lower():
                raise MarginError(f"`id` and a result are both called `{name}`.")
            seen.add(name.lower())

    def finish(self, rows: DataFrame, keys: dict[str, str], bits: dict[str, str], set_id: str | None, outputs: list[str]) -> DataFrame:
        """Label, order columns, order rows. keys: the column of ``rows`` that holds each key; bits, set_id: SQL."""
        plan, schema = self.plan, self.df.schema
        columns = [F.expr(f"{quoted(keys[b])} as {quoted(b)}") for b in plan.by]
        for d in plan.dims:
            extra = new_metadata(schema, d, self.labels[d], self.position)
            if extra is None and not isinstance(self.labels[d], str):
                columns.append(F.expr(f"{quoted(keys[d])} as {quoted(d)}"))
                continue
            value = labelled(F.col(quoted(keys[d])), F.expr(f"{bits[d]} = 1"), self.labels[d])
            columns.append(value.alias(d, metadata=extra) if extra else value.alias(d))
        if self.id:
            columns.append(F.expr(f"cast({set_id} as int) as {quoted(self.id)}"))
        columns += [F.col(quoted(o)) for o in outputs]
        if self.sort == "none":
            return rows.select(*columns)
        helpers = [F.expr(f"{bits[d]} as {self.names.new(f'sort_{k}')}") for k, d in enumerate(plan.dims)]
        last = [F.expr(f"{set_id} as {self.names.new('sort_id')}")] if set_id is not None else []
        out = rows.select(*columns, *helpers, *last)
        bit_names, id_names = out.columns[len(columns) : len(columns) + len(helpers)], out.columns[len(columns) + len(helpers) :]
        order: list[Column] = [self._key(b).asc_nulls_last() for b in plan.by]
        for d, b in zip(plan.dims, bit_names):
            order += [F.col(b).desc() if self.sort == "first" else F.col(b).asc(), self._key(d).asc_nulls_last()]
        order += [F.col(n).asc() for n in id_names]
        return out.orderBy(*order).drop(*bit_names, *id_names) if order else out

    def _key(self, name: str) -> Column:
        levels = levels_of(self.df.schema, name)
        if levels is None:
            return F.col(quoted(name))
        if isinstance(label := self.labels.get(name), str):
            levels = [label, *levels] if self.position == "first" else [*levels, label]
        place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(quoted(name)).cast("string"))
        return F.when(place > 0, place)


def prepare(df, by, grouping, margin_label, margin_label_position, check_margin_label, duplicates, id, sort, policies=POLICIES) -> Operation:
    from pyspark.sql import DataFrame as Classic

    if not isinstance(df, Classic):
        raise MarginError(f"A DataFrame is needed, not {type(df).__name__}.")
    if margin_label_position not in ("last", "first"):
        raise MarginError("`margin_label_position` must be 'last' or 'first'.")
    if sort not in ("none", "last", "first"):
        raise MarginError("`sort` must be 'none', 'last' or 'first'.")
    if not isinstance(check_margin_label, bool):
        raise MarginError("`check_margin_label` must be True or False.")
    if id is not None and (not isinstance(id, str) or not id):
        raise MarginError("`id` must be a non-empty name.")
    plan = compile_plan(df.schema, by, grouping, duplicates, policies)
    if id is not None and id.lower() in {c.lower() for c in df.columns}:
        raise MarginError(f"`id` can't be `{id}`, a column of the data.")
    return Operation(df, plan, resolve_labels(plan, margin_label), margin_label_position, check_margin_label, id, sort, Names(df.columns))


def set_array(ids: list[int]) -> Column:
    return F.array(*[F.lit(i) for i in ids])


def by_set(set_id: str, values: dict[int, int]) -> str:
    """SQL for a constant for each set."""
    return f"get(array({', '.join(str(values.get(i, 'null')) for i in range(1, max(values) + 1))}), {set_id} - 1)"


def expanded(op: Operation, distinct: bool = False) -> tuple[DataFrame, dict[str, str], str]:
    """Each row once per set (one scan): masked copies of the dimensions, and the set's number."""
    plan = op.plan
    set_name = op.names.new("set")
    ids = [i[0] for i in plan.distinct.values()] if distinct else list(plan.ids)
    rows = op.df.withColumn(set_name, F.explode(set_array(ids)))
    keys = {b: b for b in plan.by}
    columns = {}
    for k, d in enumerate(plan.dims):
        keys[d] = op.names.new(f"key_{k}")
        inside = ", ".join(str(i) for i in ids if d in plan.sets[i - 1])
        columns[keys[d]] = F.expr(f"if({set_name} in ({inside}), {quoted(d)}, null)")
    return (rows.withColumns(columns) if columns else rows), keys, set_name


def set_bits(op: Operation, set_id: str) -> dict[str, str]:
    return {d: by_set(set_id, {i: int(d not in op.plan.sets[i - 1]) for i in op.plan.ids}) for d in op.plan.dims}
