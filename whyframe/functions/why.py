"""Why-provenance as columns: sets of witness sets of row ids.

A provenance value is an ``array<array<id>>``: alternative witness sets, each of
which suffices for the row. Sums are unions and products are pairwise unions;
no witness set absorbs another. The canonical form sorts ids in a set and the
sets themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs of sets that ``formula_of_times`` holds at once, about.
PAIRS = 65_536


def distinct_sets(p: Column) -> Column:
    """The sets of p in order, each once.

    Equal neighbours go after a sort: ``array_distinct`` compares all pairs where
    the elements are arrays, the square of a group's size. The sorted array is
    bound once, so the filter is one pass.
    """
    once = lambda s: F.filter(s, lambda w, i: (i == 0) | ~w.eqNullSafe(F.get(s, i - 1)))
    return F.transform(F.array(F.sort_array(p)), once)[0]


def base(rid: Column) -> Column:
    """A base row: one witness set with its own id."""
    return F.array(F.array(rid))


def witness(*rids: Column) -> Column:
    """The one witness set of a row that comes from one row each of some tables; missing sides give no id."""
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*rids))))


def times(p: Column, q: Column) -> Column:
    """Joint use: every set of p united with every set of q; a null side (outer joins) is neutral."""
    pairs = F.flatten(F.transform(p, lambda a: F.transform(q, lambda b: F.sort_array(F.array_union(a, b)))))
    both = distinct_sets(pairs)
    return F.when(p.isNull(), q).when(q.isNull(), p).otherwise(both)


def plus(p: Column) -> Column:
    """Aggregate: the union over a group's rows; empty for an empty group."""
    return distinct_sets(F.flatten(F.collect_list(p)))


def plus_witnesses(w: Column) -> Column:
    """Aggregate over rows with one witness set each."""
    return F.sort_array(F.collect_set(w))


def canonical(p: Column) -> Column:
    return distinct_sets(F.transform(p, lambda w: F.sort_array(w)))


def digest(p: Column) -> Column:
    """A 64-bit fingerprint of the distinct sets, whatever their order."""
    marks = F.array_distinct(F.transform(p, lambda w: F.xxhash64(w)))
    return F.xxhash64(F.size(marks).cast("long"), F.aggregate(marks, F.lit(0).cast("long"), lambda a, m: a.bitwiseXOR(m)))


def digest_of_marks(mark: str) -> Column:
    """Aggregate: ``digest`` from a column with the hash of each row's one set."""
    return F.expr(f"xxhash64(count(DISTINCT `{mark}`), coalesce(bit_xor(DISTINCT `{mark}`), 0L))")


def _set_text(w: Column) -> Column:
    return F.when(F.size(w) == 1, w[0]).otherwise(F.concat(F.lit("("), F.array_join(w, " AND "), F.lit(")")))


def formula(p: Column) -> Column:
    """Boolean formula, sets in the order given: ``a OR (b AND c)``; an empty set prints as ``()``."""
    return F.array_join(F.transform(p, _set_text), " OR ")


def formula_of_times(p: Column, q: Column, pairs: int = PAIRS) -> Column:
    """``formula(times(p, q))`` of sides in canonical form that aren't null, without an array of all pairs.

    The smallest ids of the sets are cut into ranges. A range's text is made from
    the pairs whose smallest id lies in it, about ``pairs`` of them unless many
    sets begin with the same id. Ranges follow each other as the sets do, and no
    set is in two of them.
    """
    head = lambda w: F.get(w, F.lit(0))
    joint = lambda x, y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.sort_array(F.array_union(a, b)))))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is computed once, not at every use
    since = lambda s, low: F.filter(s, lambda w: head(w).isNull() | (head(w) >= low))  # noqa: E731  the empty set begins nowhere

    def text(low: Column, high: Column) -> Column:
        within = lambda s: F.filter(s, lambda w: (head(w) >= low) & (high.isNull() | (head(w) < high)))
        sets = F.concat(joint(within(p), since(q, low)), joint(within(q), since(p, high)))
        return F.concat_ws(" OR ", F.transform(distinct_sets(sets), _set_text))

    heads = F.sort_array(F.array_distinct(F.array_compact(F.concat(F.transform(p, head), F.transform(q, head)))))
    every = lambda n: F.ceil(n * F.lit(float(pairs)) / F.greatest(F.size(p).cast("double") * F.size(q), F.lit(1.0)))
    lows = bound(heads, lambda hs: F.filter(hs, lambda h, i: i % every(F.size(hs)) == 0))
    texts = F.filter(bound(lows, lambda ls: F.transform(ls, lambda low, i: text(low, F.get(ls, i + 1)))), lambda t: t != "")
    none = (F.size(F.get(p, F.lit(0))) == 0) & (F.size(F.get(q, F.lit(0))) == 0)
    return F.concat_ws(" OR ", F.when(none, F.lit("()")), texts)  # which, unlike array_join, sizes its buffer first
