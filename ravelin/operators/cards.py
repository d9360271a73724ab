"""Result cards: a record cut down to what a reader needs. Built on the driver for the page only."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ravelin.config import Config
from ravelin.functions import text as tx
from ravelin.functions.dates import display_date
from ravelin.operators.mapping import Mapping

MIN_CHARS, TITLE_CHARS, MAX_CHARS = 40, 240, 300
LEAD = 40


@dataclass
class Card:
    id: str
    title: str | None
    group: str | None
    group_name: str | None
    date: str | None
    fields: dict[str, str] = field(default_factory=dict)
    snippet: str | None = None
    rank: int | None = None
    relevance: float | None = None
    other_group: bool = False


def prefix_stem(word: str) -> str:
    """Enough of a word to know its other forms by: two letters less, four at least."""
    return word if len(word) <= 4 else word[: max(len(word) - 2, 4)]


def snippet(texts: list[str], highlight: list[str], shown: list[str], limit: int) -> str | None:
    """The sentence with the most different query words that isn't on the card already, cut around the first of them."""
    stems = [prefix_stem(w) for w in highlight]
    best, best_hits, best_at = None, 0, 0
    for t in texts:
        flat = tx.squeeze(t)
        if any(flat in s for s in shown):
            continue
        for part in tx.sentences(flat):
            if any(part in s for s in shown):
                continue
            hits, first = set(), None
            at = 0
            for w in tx.tokens(part):
                at = part.lower().find(w, at)
                k = next((i for i, s in enumerate(stems) if w.startswith(s)), None)
                if k is not None:
                    hits.add(k)
                    first = at if first is None else first
                at += len(w)
            if len(hits) > best_hits:
                best, best_hits, best_at = part, len(hits), first or 0
    if best is None or len(best) <= limit:
        return best
    start = max(best_at - LEAD, 0)
    return ("…" if start else "") + tx.truncate(best[start:], limit)


def card(key: str, doc: str, mapping: Mapping, highlight: list[str] = (), max_chars: int = MAX_CHARS) -> Card:
    record = json.loads(doc)
    limit = max(max_chars, MIN_CHARS)
    title = mapping.first(mapping.title, record)
    title = title if title is None else tx.truncate(tx.squeeze(title), min(limit, TITLE_CHARS))
    grp, name = mapping.group_of(record)
    date = mapping.date_of(record)
    shown = [title] if title else []
    fields: dict[str, str] = {}
    for p in mapping.display:
        joined = "; ".join(dict.fromkeys(tx.squeeze(v) for v in mapping.strings(p, record)))
        if joined and joined != title:
            shown.append(joined)
            fields[p.raw.replace("[]", "")] = tx.truncate(joined, limit)
    found = snippet(mapping.body_texts(record), list(highlight), shown, limit) if highlight else None
    return Card(key, title, grp, name, date and display_date(date), fields, found)


def card_table(rows: DataFrame, config: Config, highlight: list[str] = (), max_chars: int = MAX_CHARS) -> DataFrame:
    """(seq, id, title, grp, grp_name, date, snippet): the cards of many rows (seq, id, kind, doc), where they are read."""
    shared = rows.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mappings = {k: Mapping(f, shared.value.rank, k) for k, f in shared.value.mappings()}
        for pdf in batches:
            made = [(seq, card(key, doc, mappings[kind if kind in mappings else None], highlight, max_chars)) for seq, key, kind, doc in pdf[["seq", "id", "kind", "doc"]].itertuples(index=False)]
            yield pd.DataFrame([(seq, c.id, c.title, c.group, c.group_name, c.date, c.snippet) for seq, c in made], columns=["seq", "id", "title", "grp", "grp_name", "date", "snippet"])

    return rows.select("seq", "id", "kind", "doc").mapInPandas(run, "seq long, id string, title string, grp string, grp_name string, date string, snippet string")
