"""Compact text of outcomes, for terminals."""

from __future__ import annotations

from ravelin.operators.cards import Card
from ravelin.operators.store import AggregateOutcome, Description, SearchOutcome


def thousands(n: int) -> str:
    return f"{n:,}"


def number(v: float) -> str:
    return thousands(int(v)) if float(v).is_integer() else f"{v:,.6f}".rstrip("0").rstrip(".")


def card(c: Card) -> str:
    head = " · ".join(x for x in (c.id, c.date, c.group_name or c.group, c.title) if x)
    lines = [(f"{c.rank}. " if c.rank else "- ") + head]
    lines += [f"   {k}: {v}" for k, v in c.fields.items()]
    return "\n".join([*lines, *([f"   {c.snippet}"] if c.snippet else [])])


def search(o: SearchOutcome) -> str:
    if o.status != "ok":
        return "\n".join([*o.notes, *(f"- {g.key} {g.name or ''} ({thousands(g.records)})" for g in o.candidates)])
    head = f"{thousands(o.total_matches)} matches" + (f" in {o.group.name or o.group.key}" if o.group else "")
    return "\n".join([head, *map(card, o.results), *(["other groups:"] if o.other_groups else []), *map(card, o.other_groups), *o.notes])


def aggregate(o: AggregateOutcome) -> str:
    if o.status != "ok":
        return "\n".join(o.notes)
    rows = [f"{r.key or '(none)'}{f' ({r.name})' if r.name else ''}: {number(r.value)}" for r in o.rows]
    more = [f"… {thousands(o.buckets - len(o.rows))} more"] if o.buckets > len(o.rows) else []
    return "\n".join([f"{o.metric} {number(o.value)} over {thousands(o.records)} records", *rows, *more, *o.notes])


def describe(d: Description) -> str:
    facets = [f"{f.field} ({f.distinct}): " + ", ".join(f"{v} {n}" for v, n in f.top) for f in d.facets]
    groups = [f"- {g.key} {g.name or ''} ({thousands(g.records)})" for g in d.largest_groups]
    return "\n".join([f"{thousands(d.records)} records, {thousands(d.groups)} groups, {d.date_min or '?'} to {d.date_max or '?'}", *facets, *groups])
