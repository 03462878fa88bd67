"""The chain of model providers as a table of entries: S17, P8, P9, O7, O8, F36."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import policy

# Kinds of providers that search, whatever their tags.
SEARCH_KINDS = ("tavily", "parallel")


def servable(entries: DataFrame, slots: list[str]) -> DataFrame:
    """Entries (ord, kind, secret_slot, base_url, capabilities) whose slot is a provider's, and whose address, where the kind has one of its own, is allowed."""
    own = F.col("kind") == "openai-compatible"
    address = F.when(own, F.coalesce(policy.destination_allowed(F.col("base_url")), F.lit(False))).otherwise(F.lit(True))
    return entries.where(F.col("secret_slot").isin(*slots) & address)


def resolve(entries: DataFrame, slots: list[str], secrets: DataFrame) -> DataFrame:
    """The servable entries whose secret is there, with their stored place `ord`."""
    return servable(entries, slots).join(secrets.select("secret_slot").distinct(), "secret_slot", "left_semi")


def for_capability(entries: DataFrame, capability: str) -> DataFrame:
    """The entries for one kind of call. Those that search never chat; others chat unless tagged to search or extract."""
    searches = F.col("kind").isin(*SEARCH_KINDS)
    tags = F.coalesce("capabilities", F.array().cast("array<string>"))
    if capability == "chat":
        return entries.where(~searches & ~F.arrays_overlap(tags, F.array(F.lit("search"), F.lit("extract"))))
    tagged = F.array_contains(tags, capability)
    return entries.where(searches | tagged if capability in ("search", "extract") else tagged)


def moved(items: Column, start: int, end: int) -> Column:
    """A list with its item at `start` moved to `end`, both counted from 0; an error where either is out of range."""
    others = F.concat(F.slice(items, 1, start), F.slice(items, start + 2, F.greatest(F.size(items), F.lit(1))))
    out = F.concat(F.slice(others, 1, end), F.slice(items, start + 1, 1), F.slice(others, end + 1, F.greatest(F.size(items), F.lit(1))))
    good = (F.lit(start) >= 0) & (F.lit(end) >= 0) & (F.size(items) > max(start, end))
    return F.when(good, out).otherwise(F.raise_error(F.format_string(f"reorder out of range: from={start} to={end} len=%d", F.size(items))).cast("array<string>"))


def pages_wanted(pages: Column, n_pages: Column, most: int = 50) -> Column:
    """Distinct page numbers of a document in order, the first `most`."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= n_pages)))), 1, most)


def strings_of(json: Column) -> Column:
    """the strings of a JSON array; nothing where it is none."""
    parsed = F.from_json(json, "array<string>")
    whole = F.from_json(json, "array<variant>")
    kept = F.filter(F.zip_with(parsed, whole, lambda s, v: F.struct(s.alias("s"), F.schema_of_variant(v).alias("t"))), lambda x: x["t"] == "STRING")
    return F.coalesce(F.transform(kept, lambda x: x["s"]), F.array().cast("array<string>"))


def exhibits_of(json: Column) -> Column:
    """exhibits (doc_id, snippet) of a JSON array; nothing unless every one has both as strings."""
    fields = F.from_json(json, "array<struct<doc_id:variant,snippet:variant>>")
    text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    good = F.forall(fields, lambda e: F.coalesce(text(e["doc_id"]) & text(e["snippet"]), F.lit(False)))
    parsed = F.from_json(json, "array<struct<doc_id:string,snippet:string>>")
    return F.when(good, parsed).otherwise(F.array().cast("array<struct<doc_id:string,snippet:string>>"))
