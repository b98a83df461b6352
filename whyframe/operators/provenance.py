"""SQL with why-provenance: the analysed plan, annotated node by node.

Every operator keeps its own expressions and output attributes; the rewrite only
carries more columns along, so Catalyst optimises the annotated query like any
other. Until the first aggregate, distinct or set operation a row has exactly
one witness set, which is carried as plain id columns, one for each base table
(``flat``); above that as an array of sets.

Rules: selection, projection, sorting, limits and windows keep a row's
provenance; joins multiply it; grouping, distinct and UNION add it up over equal
rows; the rows of a recursive table multiply along their derivation; INTERSECT
multiplies the sums of both sides; a semi join, IN or EXISTS multiplies by the
sum of the matches, by whatever condition, and where it is a part of a condition
if there are matches; anti joins, NOT IN and EXCEPT keep the left side's, as do
scalar subqueries, correlated or not; a row made from constants has the empty
witness set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import why
from ..plans.catalyst import Catalyst
from ..sources.catalog import row_id
from ..sources.tables import id_parts

WHY = "why"
MODES = ("full", "formula", "rows", "count", "digest", "off")
#: Nodes that count rows, which rows with several witnesses each would upset.
COUNTING = ("GlobalLimit", "LocalLimit", "Offset", "Tail", "Sample", "Window")
#: Nodes with one child that keep rows, or keep some of them, as they are.
ROWWISE = ("Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Window", "Generate", "ResolvedHint", "Repartition", "RepartitionByExpression", "WithWindowDefinition", "Tail", "Sample", "PipeOperator")
#: Groups up to which a plain result is sent to the rows it was made from.
FEW = 10_000
#: Types of whole numbers, the narrowest first.
WIDTHS = ("tinyint", "smallint", "int", "bigint")
CONSTANT = ("LocalRelation", "OneRowRelation", "Range", "EmptyRelation")


@dataclass
class Annotated:
    """A plan and the names of its id columns (flat) or of its one array column; ``many``: a row for each witness; ``ordered``: the array is in canonical form."""

    plan: object
    names: list[str]
    flat: bool
    summed: bool = False
    many: bool = False
    ordered: bool = False


class Rewriter:
    def __init__(self, spark: SparkSession, rid: Callable[[str, list[str]], Column] = row_id, hashed: bool = False):
        self.c, self.rid, self.hashed, self.next = Catalyst(spark), rid, hashed, count()
        self.tables: list[str] = []
        self.mode, self.top = "full", None
        self.loops: dict[int, tuple] = {}

    def fresh(self) -> str:
        return f"__w{next(self.next)}"

    # helpers over plans

    def _attr(self, plan, name: str):
        return next(a for a in self.c.items(plan.output()) if a.name() == name)

    def _with(self, plan, name: str, value: Column, drop: list[str] = ()):
        return self.c.plan_of(self.c.frame(plan).withColumn(name, value).drop(*drop))

    def _as_sets(self, x: Annotated) -> Annotated:
        if not x.flat:
            return x
        name = self.fresh()
        value = F.array(why.witness(*[F.col(n) for n in x.names])) if x.names else F.expr(f"array(cast(array() as array<{'bigint' if self.hashed else 'string'}>))")
        return Annotated(self._with(x.plan, name, value, x.names), [name], False)

    def _summed(self, x: Annotated, grouping: list, outputs: list) -> Annotated:
        """Aggregate of x with its provenance added up."""
        name = self.fresh()
        total = why.plus_witnesses(why.witness(*[F.col(n) for n in x.names])) if x.flat and x.names else why.plus(F.col(self._ensure(x).names[0]))
        x = self._ensure(x)
        alias = self.c.items(self.c.plan_of(self.c.frame(x.plan).agg(total.alias(name))).aggregateExpressions())[0]
        none = getattr(self.c.jvm, "scala.None$")
        plan = self.c.make("Aggregate", self.c.seq(grouping), self.c.seq([*outputs, alias]), x.plan, getattr(none, "MODULE$"))
        return Annotated(plan, [name], False)

    def _ensure(self, x: Annotated) -> Annotated:
        if not x.flat or x.names:
            return x
        if not hasattr(x, "_sets"):
            x._sets = self._as_sets(x)
        return x._sets

    # nodes

    def annotate(self, node, table: str | None = None) -> Annotated:
        kind = node.nodeName()
        if kind == "SubqueryAlias":
            return self.annotate(node.child(), node.alias())
        if kind == "View":
            name = node.desc().identifier().table().lower()  # not an alias that the query made up
            return self._leaf(node, name) if name in self.base else self.annotate(node.child())
        found = getattr(self, f"_on_{kind.replace(' ', '_').lower()}", None)
        if found is not None:
            return found(node)
        children = self.c.children(node)
        if not children:
            if kind in CONSTANT:
                return Annotated(node, [], True)
            if kind == "LogicalRelation" and node.catalogTable().isDefined():
                name = node.catalogTable().get().identifier().table().lower()
                if name in self.base:
                    return self._leaf(node, name)
            raise NotImplementedError(f"rows of {table or kind} have no ids: it isn't a registered table")
        if len(children) == 1 and kind in ROWWISE:
            x = self.annotate(children[0])
            if x.many and kind in COUNTING:
                raise NotImplementedError(f"prov='rows' has no rule for {kind} over rows with several witnesses")
            return Annotated(node.withNewChildren(self.c.seq([x.plan])), x.names, x.flat, x.summed, x.many)
        raise NotImplementedError(f"no provenance rule for {kind}")

    def _leaf(self, node, table: str) -> Annotated:
        df, name = self.c.frame(node), self.fresh()
        self.tables.append(table)
        rid = self.rid(table, df.columns)
        if self.hashed:
            parts = id_parts(table, df.columns) if self.rid is row_id else None
            rid = F.xxhash64(rid) if parts is None else F.xxhash64(F.lit(table), *parts)  # no text is built
        return Annotated(self.c.plan_of(df.withColumn(name, rid)), [name], True)

    def _on_project(self, node) -> Annotated:
        x = self.annotate(node.child())
        kept = [self._attr(x.plan, n) for n in x.names]
        return Annotated(self.c.make("Project", self.c.seq([*self.c.items(node.projectList()), *kept]), x.plan), x.names, x.flat, x.summed, x.many)

    def _on_aggregate(self, node) -> Annotated:
        return self._grouped(node, self.annotate(node.child()), self.c.items(node.groupingExpressions()), self.c.items(node.aggregateExpressions()))

    def _on_distinct(self, node) -> Annotated:
        output = self.c.items(node.child().output())
        if self.mode == "rows":
            x = self.annotate(node.child())
            return Annotated(x.plan, x.names, True, many=True)
        return self._grouped(node, self.annotate(node.child()), output, output)

    def _grouped(self, node, x: Annotated, grouping: list, outputs: list) -> Annotated:
        """As ``_summed``, but the last sum of a query whose rows have one witness each needs no sets in modes count and digest."""
        if self.mode == "rows":
            return self._joined_back(node, x, grouping, outputs)
        if self.top is None or not node.fastEquals(self.top) or not x.flat or not x.names:
            return self._summed(x, grouping, outputs)
        name = self.fresh()
        mark = F.xxhash64(why.witness(*[F.col(n) for n in x.names]))
        plan = self._with(x.plan, name, mark)
        total = why.digest_of_marks(name) if self.mode == "digest" else F.count_distinct(name)
        alias = self.c.items(self.c.plan_of(self.c.frame(plan).agg(total.alias(name + "s"))).aggregateExpressions())[0]
        made = self.c.make("Aggregate", self.c.seq(grouping), self.c.seq([*outputs, alias]), plan, getattr(getattr(self.c.jvm, "scala.None$"), "MODULE$"))
        return Annotated(made, [name + "s"], False, True)

    def _joined_back(self, node, x: Annotated, grouping: list, outputs: list) -> Annotated:
        """A group's result beside each of its witnesses: the plain aggregate joined by its keys to the rows it was made from.

        No group's witnesses meet in one place; a key with many of them is split by the join like any other.
        """
        keys = [self.fresh() for _ in grouping]
        told = self.c.items(self.c.plan_of(self.c.frame(node.child()).select(*[self.c.column(g).alias(k) for g, k in zip(grouping, keys)])).projectList()) if keys else []
        plain = self.c.frame(self.c.make("Aggregate", self.c.seq(grouping), self.c.seq([*outputs, *told]), node.child(), getattr(getattr(self.c.jvm, "scala.None$"), "MODULE$")))
        if keys and self._few(node, plain):  # else rows with few keys would meet in few tasks
            plain = F.broadcast(plain)
        rows, name, own = self.c.frame(x.plan), self.fresh(), [self.fresh() for _ in grouping]
        rows = rows.select(*[self.c.column(g).alias(k) for g, k in zip(grouping, own)], self._witness(x).alias(name))
        if not keys:  # a global aggregate is one row
            both = F.broadcast(plain).crossJoin(rows)
        else:
            same = F.lit(True)
            for a, b in zip(keys, own):
                same = same & F.col(a).eqNullSafe(F.col(b))
            both = plain.join(rows, same)  # the left side of a join keeps its attributes
        plan = self.c.plan_of(both)
        ids = {a.exprId().id() for a in self.c.items(node.output())}
        kept = [a for a in self.c.items(plan.output()) if a.exprId().id() in ids]
        return Annotated(self.c.make("Project", self.c.seq([*kept, self._attr(plan, name)]), plan), [name], True, many=True)

    def _few(self, node, plain: DataFrame) -> bool:
        """Whether a plain aggregate has few groups, which it is run to tell; inside a recursion it can't be."""
        if any(x.nodeName() == "UnionLoopRef" for x in self.c.walk(node)):
            return False
        return plain.limit(FEW + 1).count() <= FEW

    def _witness(self, x: Annotated) -> Column:
        """The one witness of each row of a flat plan; some columns are ids, some already sets of them."""
        if not x.names:
            return F.expr("cast(array() as array<string>)")
        kinds = dict(self.c.frame(x.plan).select(*x.names).dtypes)
        sets = [F.coalesce(F.col(n), F.expr("cast(array() as array<string>)")) if kinds[n].startswith("array") else F.array(F.col(n)) for n in x.names]
        return F.sort_array(F.array_distinct(F.array_compact(F.concat(*sets))))

    def _last(self, node, *kinds: str):
        """The topmost node of these kinds if only row-wise nodes stand above it."""
        while node.nodeName() in (*ROWWISE, "Project", "SubqueryAlias"):
            node = self.c.children(node)[0]
        return node if node.nodeName() in kinds else None

    def _on_expand(self, node) -> Annotated:
        x = self.annotate(node.child())
        kept = [self._attr(x.plan, n) for n in x.names]
        rows = [self.c.seq([*self.c.items(p), *kept]) for p in self.c.items(node.projections())]
        return Annotated(self.c.make("Expand", self.c.seq(rows), self.c.seq([*self.c.items(node.output()), *kept]), x.plan), x.names, x.flat)

    def _on_union(self, node) -> Annotated:
        name, plans, many = self.fresh(), [], False
        for child in self.c.children(node):
            x = self.annotate(child)
            many = many or x.many
            x = x if self.mode == "rows" else self._as_sets(x)
            output = self.c.items(child.output())
            renamed = self._with(x.plan, name, self._witness(x) if self.mode == "rows" else F.col(x.names[0]))
            plans.append(self.c.make("Project", self.c.seq([*output, self._attr(renamed, name)]), renamed))
        return Annotated(node.withNewChildren(self.c.seq(plans)), [name], self.mode == "rows", many=many)

    def _on_unionloop(self, node) -> Annotated:
        """A recursive table: every round carries the provenance of the rows that it starts from.

        Rounds add rows without merging any, so a row has the witness of its one
        derivation, and the recursion ends where the plain query's does.
        """
        start, output = self._one_column(self.annotate(node.anchor())), self.c.items(node.anchor().output())
        mark = self._attr(start.plan, start.names[0])
        self.loops[node.id()] = mark, start.many
        step = self.annotate(node.recursion())
        if step.many and not start.many:  # a round's rows then have several witnesses, for the next round as well
            self.loops[node.id()] = mark, True
            step = self.annotate(node.recursion())
        step = self._one_column(step)
        own, told = self.c.items(node.recursion().output()), mark.newInstance()
        first = self.c.make("Project", self.c.seq([*output, mark]), start.plan)
        again = self.c.make("Project", self.c.seq([*own, self._attr(step.plan, step.names[0])]), step.plan)
        ids = self.c.seq([*self.c.items(node.outputAttrIds()), told.exprId()])
        return Annotated(self.c.make("UnionLoop", node.id(), first, again, ids, node.limit(), node.maxDepth()), start.names, start.flat, many=step.many)

    def _on_unionloopref(self, node) -> Annotated:
        """The rows of the round before, with their provenance."""
        mark, many = self.loops[node.loopId()]
        mark = mark.newInstance().withNullability(True).withName(self.fresh())
        made = self.c.make("UnionLoopRef", node.loopId(), self.c.seq([*self.c.items(node.output()), mark]), node.accumulated())
        return Annotated(made, [mark.name()], self.mode == "rows", many=many)

    def _one_column(self, x: Annotated) -> Annotated:
        """x with its provenance in one column: a witness in mode rows, sets otherwise."""
        if self.mode != "rows":
            return self._as_sets(x)
        name = self.fresh()
        return Annotated(self._with(x.plan, name, self._witness(x), x.names), [name], True, many=x.many)

    def _on_join(self, node) -> Annotated:
        kind, right = node.joinType().toString(), node.right()
        if kind.startswith("ExistenceJoin"):
            return self._existence(node)
        left = self.annotate(node.left())
        if kind.startswith("LeftAnti") or self._looks_up(node):
            return Annotated(node.withNewChildren(self.c.seq([left.plan, right])), left.names, left.flat, left.summed, left.many)
        if kind.startswith("LeftSemi"):
            return self._beside(node, left, None) if self.mode == "rows" else self._semi(node, left)
        r = self.annotate(right)
        if left.flat and r.flat:
            return Annotated(node.withNewChildren(self.c.seq([left.plan, r.plan])), left.names + r.names, True, many=left.many or r.many)
        left, r, name = self._as_sets(left), self._as_sets(r), self.fresh()
        joined = node.withNewChildren(self.c.seq([left.plan, r.plan]))
        product = why.times(F.col(left.names[0]), F.col(r.names[0]))
        return Annotated(self._with(joined, name, product, left.names + r.names), [name], False)

    def _looks_up(self, node) -> bool:
        """Whether a join's right side is a scalar subquery, whose value is looked up for each row of the left.

        Where it depends on the row by more than equality, it holds the left's own leaves once more, for the values to look up.
        """
        left, right = ({a.exprId().id() for leaf in self.c.leaves(x) for a in self.c.items(leaf.output())} for x in (node.left(), node.right()))
        return bool(right & self.c.looked_up) and right <= self.c.looked_up | left

    def _semi(self, node, left: Annotated) -> Annotated:
        keys = self._equalities(node)
        if keys is None:
            return self._matched(node, left, None)
        right = self._summed(self.annotate(node.right()), keys, keys)
        left, name = self._as_sets(left), self.fresh()
        joined = self.c.make("Join", left.plan, right.plan, self.c.inner(), node.condition(), node.hint())
        product = why.times(F.col(left.names[0]), F.col(right.names[0]))
        plan = self._with(joined, name, product, left.names + right.names)
        return Annotated(self.c.make("Project", self.c.seq([*self.c.items(node.left().output()), self._attr(plan, name)]), plan), [name], False)

    def _existence(self, node) -> Annotated:
        """EXISTS or IN below OR or in a SELECT list: matches count where there are some and where they speak for the row."""
        left, exists = self.annotate(node.left()), node.joinType().exists()
        if exists.exprId().id() in self.denied:
            return Annotated(node.withNewChildren(self.c.seq([left.plan, node.right()])), left.names, left.flat, many=left.many)
        return self._beside(node, left, exists) if self.mode == "rows" else self._matched(node, left, exists)

    def _beside(self, node, left: Annotated, exists) -> Annotated:
        """As ``_matched``, with a row for each match."""
        right, mark = self.annotate(node.right()), self.fresh()
        if left.names and not any(x.nodeName() == "UnionLoopRef" for x in self.c.walk(left.plan)):
            # a row may have very many matches: the rows are dealt out evenly first, in a number that adaptive execution keeps
            n = int(self.c.spark.conf.get("spark.sql.shuffle.partitions"))
            left = Annotated(self.c.plan_of(self.c.frame(left.plan).repartition(n, *left.names)), left.names, left.flat, left.summed, left.many)
        plan = self._with(right.plan, mark, F.lit(True))
        joined = self.c.make("Join", left.plan, plan, self.c.inner() if exists is None else self.c.left_outer(), node.condition(), node.hint())
        kept = [*self.c.items(node.left().output()), *[self._attr(joined, n) for n in (*left.names, *right.names)]]
        if exists is not None:
            kept.append(self.c.alias_as(F.col(mark).isNotNull(), exists, joined))
        return Annotated(self.c.make("Project", self.c.seq(kept), joined), left.names + right.names, True, many=True)

    def _matched(self, node, left: Annotated, exists) -> Annotated:
        """Left rows times the sum of their matches by any condition.

        A left row is known by its ids and, where rows may share these, by its
        values. The sums of the matches are made by that key from an inner join
        and joined back; without ``exists`` rows without matches go, else they
        stay as they are and ``exists`` tells them apart.
        """
        if any(x.nodeName() == "UnionLoopRef" for x in self.c.walk(left.plan)):
            raise NotImplementedError("no provenance rule for matches by other than equality, or under OR, inside a recursion")
        right, output = self.annotate(node.right()), self.c.items(node.left().output())
        joined = self.c.frame(self.c.make("Join", left.plan, self._ensure(right).plan, self.c.inner(), node.condition(), node.hint()))
        right = self._ensure(right)
        values = [] if left.flat and left.names and not self._repeats(node.left()) else [self.c.column(a) for a in output]
        keys = [*[F.col(n) for n in left.names], *values]
        named = [self.fresh() for _ in keys]
        total = why.plus_witnesses(why.witness(*[F.col(n) for n in right.names])) if right.flat and right.names else why.plus(F.col(right.names[0]))
        sums = self.fresh()
        matches = joined.groupBy(*[k.alias(n) for k, n in zip(keys, named)]).agg(total.alias(sums))
        own = self._as_sets(Annotated(self._with_marks(left), left.names, left.flat))
        mine = self.c.frame(own.plan)
        marks = [F.col(f"{n}_") for n in left.names] + values
        same = F.lit(True)
        for k, n in zip(marks, named):
            same = same & k.eqNullSafe(F.col(n))
        both = mine.join(matches, same, "inner" if exists is None else "left")
        name = self.fresh()
        plan = self.c.plan_of(both.withColumn(name, why.times(F.col(own.names[0]), F.col(sums))))
        kept = [*output, self._attr(plan, name)]
        if exists is not None:
            kept.insert(len(output), self.c.alias_as(F.col(sums).isNotNull(), exists, plan))
        return Annotated(self.c.make("Project", self.c.seq(kept), plan), [name], False)

    def _with_marks(self, x: Annotated):
        """x with a second copy of its provenance columns, which stay when the first become sets."""
        df = self.c.frame(x.plan)
        for n in x.names:
            df = df.withColumn(f"{n}_", F.col(n))
        return self.c.plan_of(df)

    def _repeats(self, plan) -> bool:
        return plan.nodeName() in ("Generate", "Expand", "Union", "UnionLoop") or any(self._repeats(x) for x in self.c.children(plan))

    def _equalities(self, node) -> list | None:
        """The right side's attributes if the condition is a conjunction of equalities with them."""
        if node.condition().isEmpty():
            return None
        ids = lambda plan: {a.exprId().id(): a for a in self.c.items(plan.output())}
        left, right, keys, todo = ids(node.left()), ids(node.right()), {}, [node.condition().get()]
        while todo:
            e = todo.pop()
            if e.nodeName() == "And":
                todo += self.c.children(e)
                continue
            sides = [self._narrow(s) for s in self.c.children(e)]
            if e.nodeName() not in ("EqualTo", "EqualNullSafe"):
                return None
            other = [s for s in sides if s.nodeName() == "AttributeReference" and s.exprId().id() in right]
            if len(other) != 1 or not all(a.exprId().id() in left for s in sides if s is not other[0] for a in self.c.walk(s) if a.nodeName() == "AttributeReference"):
                return None
            keys[other[0].exprId().id()] = other[0]
        return list(keys.values())

    def _narrow(self, e):
        """A whole number without the cast that widens it, which keeps numbers apart."""
        if e.nodeName() == "Cast" and e.dataType().simpleString() in WIDTHS and e.child().dataType().simpleString() in WIDTHS[: WIDTHS.index(e.dataType().simpleString())]:
            return e.child()
        return e

    def _on_intersect(self, node) -> Annotated:
        return self._set_operation(node, keep=True)

    def _on_except(self, node) -> Annotated:
        return self._set_operation(node, keep=False)

    def _set_operation(self, node, keep: bool) -> Annotated:
        if node.isAll():
            raise NotImplementedError("no provenance rule for INTERSECT ALL and EXCEPT ALL")
        a, b = self.c.items(node.left().output()), self.c.items(node.right().output())
        if self.mode == "rows":
            return self._set_rows(node, a, b, keep)
        left = self._summed(self.annotate(node.left()), a, a)
        right = self._summed(self.annotate(node.right()), b, b) if keep else Annotated(node.right(), [], True)
        l, r = self.c.frame(left.plan), self.c.frame(right.plan)
        same = F.lit(True)
        for x, y in zip(a, b):
            same = same & self.c.column(x).eqNullSafe(self.c.column(y))
        if not keep:
            return Annotated(self.c.plan_of(l.join(r, same, "left_anti")), left.names, False)
        name, last = self.fresh(), self.top is not None and node.fastEquals(self.top)
        product = (why.formula_of_times if last else why.times)(F.col(left.names[0]), F.col(right.names[0]))
        both = l.join(r, same, "inner")
        if last:  # few rows may have very long texts: each is made in a task of its own, in a number that adaptive execution keeps
            both = both.repartition(int(self.c.spark.conf.get("spark.sql.shuffle.partitions")))
        both = self._with(self.c.plan_of(both), name, product)
        return Annotated(self.c.make("Project", self.c.seq([*a, self._attr(both, name)]), both), [name], False, summed=last, ordered=True)

    def _set_rows(self, node, a: list, b: list, keep: bool) -> Annotated:
        left, right = self.annotate(node.left()), self.annotate(node.right()) if keep else Annotated(node.right(), [], True)
        same = F.lit(True)
        for x, y in zip(a, b):
            same = same & self.c.column(x).eqNullSafe(self.c.column(y))
        both = self.c.plan_of(self.c.frame(left.plan).join(self.c.frame(right.plan), same, "inner" if keep else "left_anti"))
        names = left.names + right.names
        return Annotated(self.c.make("Project", self.c.seq([*a, *[self._attr(both, n) for n in names]]), both), names, True, many=True)

    # whole queries

    def _told_apart(self, plan) -> bool:
        """Whether no two rows of the relation can be equal, so that it needs no DISTINCT over all of them.

        Every row comes from one combination of base rows. Where each table stands
        once in the query, none of its nodes repeats rows, and no table has an id
        twice, which a count of its keys tells, the combinations differ in their
        witness sets. Ids that are texts of their own aren't counted.
        """
        if self.rid is not row_id or len(set(self.tables)) < len(self.tables) or any(self._strays(x) for x in self.c.walk(plan)):
            return False
        for table in self.tables:
            df = self.c.spark.table(table)
            parts = id_parts(table, df.columns)
            if parts is None:
                return False
            keyed = df.select(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
            if not keyed.where(" OR ".join(f"{c} IS NULL" for c in keyed.columns)).isEmpty():
                return False
            if not keyed.groupBy(*keyed.columns).count().where("count > 1").isEmpty():
                return False
        return True

    def _strays(self, node) -> bool:
        return node.nodeName() not in ("Aggregate", "Distinct", "Filter", "Project", "Sort", "SubqueryAlias", "Join", "View", "LogicalRelation", "ResolvedHint")

    def run(self, sql: str, base: set[str], mode: str = "full") -> DataFrame:
        """The annotated query, with columns of its own, and its provenance as ``mode`` asks."""
        self.base, self.mode = {t.lower() for t in base}, mode
        plan = self.c.analyzed(sql)
        self.denied = self.c.negated(plan)
        if any(a.name().lower() == WHY for a in self.c.items(plan.output())):
            raise ValueError(f"the query has a column {WHY}, which names the provenance: give it another name")
        self.top = None if mode == "full" else self._last(plan, *(["Intersect"] if mode == "formula" else ["Aggregate", "Distinct"]))
        x = self.annotate(plan)
        if mode == "rows":
            name = self.fresh()
            out = self.c.frame(x.plan).withColumn(name, self._witness(x)).drop(*x.names).withColumnRenamed(name, WHY)
            return out.distinct() if x.many and not self._told_apart(plan) else out
        if x.summed:
            value = F.col(x.names[0])
        else:
            if x.flat and x.names:
                value = F.array(why.witness(*[F.col(n) for n in x.names]))
            else:
                x = self._as_sets(x)
                value = F.col(x.names[0]) if x.ordered else why.canonical(F.col(x.names[0]))
            value = {"full": value, "formula": why.formula(value), "count": F.size(value).cast("long"), "digest": why.digest(value)}[mode]
        return self.c.frame(x.plan).withColumn(WHY, value).drop(*x.names)


def base_tables(spark: SparkSession) -> set[str]:
    """Registered tables that give row ids: temporary views and catalogued tables of the session."""
    return {t.name.lower() for t in spark.catalog.listTables()}


def sql_with_why(spark: SparkSession, sql: str, prov: str = "full", tables: set[str] | None = None) -> DataFrame:
    """Run a query over registered tables; ``why`` holds each row's provenance.

    prov: ``full`` for the witness sets, ``formula`` for their text (an INTERSECT's,
    which has all pairs of both sides, is written range by range, without their
    array), ``count`` for their number, ``digest`` for a 64-bit fingerprint of the
    hashed sets, ``off`` for the plain query.
    ``rows`` gives provenance as a relation: a row for each distinct result row
    and witness set (``why`` is that set; equal rows that one witness each gave
    keep their number), joined from the plain result and its rows, so that no
    group's sets meet in one array or task; a group without witnesses has no row,
    and limits and windows above a grouping are refused.
    Where a query's last sum is over rows with one witness each, ``count`` and
    ``digest`` are aggregates over 64-bit hashes of distinct witnesses (a count
    is then one too low if two of n witnesses share a hash, odds n * n / 2**65).

    Tables without row ids, such as files named by their path, are refused, as
    is a column of the name ``why``; constant rows have the empty witness set.
    """
    if prov not in MODES:
        raise ValueError(f"prov must be one of {MODES}")
    if prov == "off":
        return spark.sql(sql)
    return Rewriter(spark, hashed=prov == "digest").run(sql, tables or base_tables(spark), prov)
