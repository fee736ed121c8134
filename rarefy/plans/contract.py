"""Contractions on the driver: reading subscripts and choosing the order of joins."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Relation:
    """Rows (labels…, v) with a bound on how many there are, and about how many; sizes: of the labels."""

    df: DataFrame
    labels: list[str]
    sizes: dict[str, int] = field(default_factory=dict)
    rows: float = 1.0
    cells: float = 1.0


def pairs(a: Relation, b: Relation) -> float:
    """About how many rows a join on the common labels has, were the cells spread evenly."""
    return a.cells * b.cells / math.prod(float(max(1, a.sizes[c])) for c in a.labels if c in b.labels)


def order_of_joins(relations: list[Relation], output: list[str], join: Callable) -> Relation:
    """Joins the two relations of which the fewest pairs are expected, until one is left.

    After each join, labels that nothing else needs are summed away. Relations without a common
    label are multiplied at the end. join takes the two, the labels to keep and whether it is the last.
    """
    left = list(relations)
    while len(left) > 1:
        left.sort(key=lambda r: r.cells)
        a, b = min(itertools.combinations(left, 2), key=lambda ab: (not set(ab[0].labels) & set(ab[1].labels), pairs(*ab), ab[0].cells + ab[1].cells))
        rest = [r for r in left if r is not a and r is not b]
        needed = {c for r in rest for c in r.labels} | set(output)
        left = [*rest, join(a, b, [c for c in dict.fromkeys([*a.labels, *b.labels]) if c in needed], not rest)]
    return left[0]


@dataclass
class Subscripts:
    """Labels of each operand, with "..." where dimensions are not named."""

    terms: list[list[str]]

    def resolve(self, ndims: list[int], output: list[str] | None) -> tuple[list[list[str]], list[str]]:
        """Labels for every dimension; those of an ellipsis align from the right."""
        if len(ndims) != len(self.terms):
            raise ValueError(f"{len(self.terms)} terms for {len(ndims)} operands")
        widest = 0
        for term, n in zip(self.terms, ndims):
            named = len([c for c in term if c != "..."])
            if named > n or (named < n and "..." not in term):
                raise ValueError(f"{named} labels for {n} dimensions")
            if "..." in term:
                widest = max(widest, n - named)
        hidden = [f"e{widest - i}" for i in range(widest)]
        out_terms = []
        for term, n in zip(self.terms, ndims):
            k = n - len([c for c in term if c != "..."])
            full: list[str] = []
            for c in term:
                full += hidden[widest - k :] if c == "..." else [f"x{c}"]
            out_terms.append(full)
        if output is None:
            named = [c for term in self.terms for c in term if c != "..."]
            out = hidden + sorted(f"x{c}" for c in set(named) if named.count(c) == 1)
        else:
            out = []
            for c in output:
                out += hidden if c == "..." else [f"x{c}"]
            if len(set(out)) != len(out):
                raise ValueError("an output label is repeated")
        return out_terms, out


def _split(term: str) -> list[str]:
    out, i = [], 0
    while i < len(term):
        if term[i] == ".":
            if term[i : i + 3] != "..." or "..." in out:
                raise ValueError(f"bad ellipsis in {term!r}")
            out.append("...")
            i += 3
        elif term[i].isalpha():
            out.append(term[i])
            i += 1
        else:
            raise ValueError(f"bad label {term[i]!r}")
    return out


def parse(operands) -> tuple[Subscripts, list[str] | None, list]:
    """The terms, the output's labels (None: implicit) and the arrays of an einsum call."""
    if not operands:
        raise ValueError("no operands")
    if isinstance(operands[0], str):
        text = operands[0].replace(" ", "")
        arrays = list(operands[1:])
        if text.count("->") > 1 or ("-" in text or ">" in text) and "->" not in text:
            raise ValueError("at most one arrow")
        terms, arrow, out = text.partition("->")
        output = _split(out) if arrow else None
        return Subscripts([_split(t) for t in terms.split(",")]), output, arrays
    rest = list(operands)
    output = None
    if len(rest) % 2:
        output = [_label(c) for c in rest.pop()]
    arrays, lists = rest[::2], rest[1::2]
    return Subscripts([[_label(c) for c in term] for term in lists]), output, arrays


def _label(c) -> str:
    if c is Ellipsis:
        return "..."
    if not 0 <= int(c) < 52:
        raise ValueError("integer labels lie between 0 and 51")
    # capitals first, as in the string form's alphabetical order
    return chr(ord("A") + int(c)) if int(c) < 26 else chr(ord("a") + int(c) - 26)
