"""The one module that touches Catalyst objects through the JVM gateway."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

#: Expressions with a plan of their own.
SUBQUERIES = ("ListQuery", "ScalarSubquery", "Exists", "LateralSubquery")
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"


class Catalyst:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.session = spark, spark._jvm, spark._jsparkSession

    def parse(self, sql: str):
        """The unresolved plan; expressions know their place in the text."""
        return self.session.sessionState().sqlParser().parsePlan(sql)

    def expression(self, text: str):
        """An unresolved expression."""
        return self.session.sessionState().sqlParser().parseExpression(text)

    def analyzed(self, sql: str):
        """The resolved plan with common table expressions inlined and subqueries that depend on their row turned into joins."""
        plan = self.spark.sql(sql)._jdf.queryExecution().analyzed()
        plan = self.jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(True, False).apply(plan)
        self.looked_up = self.scalar_attributes(plan)
        for name in ("PullupCorrelatedPredicates", "RewriteLateralSubquery", "RewriteCorrelatedScalarSubquery", "RewritePredicateSubquery"):
            plan = self.rule(name).apply(plan)
        return plan

    def scalar_attributes(self, plan) -> set[int]:
        """Ids of the attributes of all leaves inside scalar subqueries."""
        found: set[int] = set()

        def visit(node, inside: bool) -> None:
            children = self.children(node)
            if inside and not children:
                found.update(a.exprId().id() for a in self.items(node.output()))
            for e in self.items(node.expressions()):
                for x in self.walk(e):
                    if x.nodeName() in SUBQUERIES:
                        visit(x.plan(), inside or x.nodeName() == "ScalarSubquery")
            for child in children:
                visit(child, inside)

        visit(plan, False)
        return found

    def leaves(self, plan) -> list:
        children = self.children(plan)
        return [y for x in children for y in self.leaves(x)] if children else [plan]

    def rule(self, name: str):
        """One of the optimizer's rules."""
        return getattr(getattr(self.jvm, f"org.apache.spark.sql.catalyst.optimizer.{name}$"), "MODULE$")

    def last_part(self, name: str) -> str:
        """A column's own name out of a qualified one, quoted where it must be."""
        try:
            part = str(self.session.sessionState().sqlParser().parseMultipartIdentifier(name).last())
        except Exception:  # not a name, such as a whole expression
            return name
        return part if part.isidentifier() and part.isascii() else "`" + part.replace("`", "``") + "`"

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session, plan), self.spark)

    def plan_of(self, df: DataFrame):
        return df._jdf.queryExecution().analyzed()

    def is_a(self, node, name: str) -> bool:
        return is_instance_of(self.spark.sparkContext._gateway, node, name)

    def inner(self):
        return getattr(getattr(self.jvm, "org.apache.spark.sql.catalyst.plans.Inner$"), "MODULE$")

    def left_outer(self):
        return getattr(getattr(self.jvm, "org.apache.spark.sql.catalyst.plans.LeftOuter$"), "MODULE$")

    def alias_as(self, value, attribute, plan):
        """``value`` over a plan under the identity of an attribute."""
        resolved = self.items(self.plan_of(self.frame(plan).select(value.alias(attribute.name()))).projectList())[0].child()
        none = getattr(getattr(self.jvm, "scala.None$"), "MODULE$")
        return self.jvm.org.apache.spark.sql.catalyst.expressions.Alias(resolved, attribute.name(), attribute.exprId(), self.seq([]), none, self.seq([]))

    def negated(self, plan) -> set[int]:
        """Ids of the attributes that conditions deny."""
        found: set[int] = set()

        def visit(e, inside: bool) -> None:
            inside = inside != (e.nodeName() == "Not")
            if e.nodeName() == "AttributeReference" and inside:
                found.add(e.exprId().id())
            for x in self.children(e):
                visit(x, inside)

        for node in self.walk(plan):
            if node.nodeName() == "Filter":
                visit(node.condition(), False)
        return found

    def no_hint(self):
        return getattr(getattr(self.jvm, f"{LOGICAL}.JoinHint$"), "MODULE$").NONE()

    def seq(self, items: list):
        return self.jvm.PythonUtils.toSeq(items)

    def items(self, seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def make(self, name: str, *args):
        return getattr(self.jvm, f"{LOGICAL}.{name}")(*args)

    def column(self, expression):
        from pyspark.sql.classic.column import Column

        return Column(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def children(self, node) -> list:
        return self.items(node.children())

    def walk(self, node) -> Iterator:
        """An expression or plan and everything below it, in order."""
        yield node
        for child in self.children(node):
            yield from self.walk(child)
