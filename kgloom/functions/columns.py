"""Column functions: names, types, labels, similarity of arrays, JSON, text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that win over others when an entity has several, and labels that say nothing about its domain.
PRIORITY_LABELS = ("Herb", "Property", "Quality", "Entity")
SYSTEM_LABELS = ("Entity", "Chunk", "File", "Folder", "Unknown")
#: The likely relationship between two entity types, as given or the other way round.
PREDICTED_TYPES = {
    ("Person", "Person"): "KNOWS",
    ("Person", "Organization"): "WORKS_FOR",
    ("Person", "Place"): "LIVES_IN",
    ("Person", "Event"): "PARTICIPATED_IN",
    ("Organization", "Place"): "LOCATED_IN",
    ("Event", "Place"): "OCCURRED_AT",
    ("Concept", "Concept"): "RELATED_TO",
}


def sanitize_rel_type(c: Column) -> Column:
    """F1: upper-case words joined by underscores, RELATED_TO when nothing is left."""
    out = F.upper(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(out.isNull() | (out == ""), F.lit("RELATED_TO")).otherwise(out)


def upper_type(c: Column) -> Column:
    """F2"""
    return F.upper(F.translate(c, " -", "__"))


def name_clean(c: Column) -> Column:
    """F3"""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def name_slug(c: Column) -> Column:
    """F3"""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_key(c: Column) -> Column:
    """F4"""
    return F.lower(F.translate(F.trim(c), " -.", "___"))


def query_terms(c: Column, n: int = 10) -> Column:
    """the first ``n`` words longer than two characters, then lower-cased and freed of marks."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 2)
    return F.slice(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[?,.!]+|[?,.!]+$", ""))), 1, n)


def is_vague(c: Column) -> Column:
    """fewer than three words of two characters or more, and no greeting."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: F.length(w) > 1)
    return (F.size(words) < 3) & ~F.arrays_overlap(words, F.array(*map(F.lit, ("hi", "hello", "hey", "thanks"))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequally long vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), _dot(a, b) / norms).otherwise(F.lit(0.0))


def jaccard_arr(a: Column, b: Column) -> Column:
    """F8"""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_arr(a: Column, b: Column) -> Column:
    """F8"""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def combined_similarity(j: Column, o: Column, c: Column) -> Column:
    """F9"""
    return F.when(c.isNotNull(), F.lit(0.3) * j + F.lit(0.3) * o + F.lit(0.4) * c).otherwise((j + o) / 2)


def hash_unit(c: Column) -> Column:
    """the first four bytes of the md5 as a number from 0 to 1."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def scope_key(ids: Column) -> Column:
    """F11"""
    return F.substring(F.md5(F.array_join(F.sort_array(ids), ",")), 1, 8)


def grade(score: Column) -> Column:
    """F12"""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def health_status(score: Column) -> Column:
    """F12"""
    return F.when(score >= 0.8, "healthy").when(score >= 0.5, "warning").otherwise("critical")


def predicted_type(a: Column, b: Column, pairs: dict[tuple[str, str], str] = PREDICTED_TYPES) -> Column:
    """``pairs`` as given first, then the other way round, else RELATED_TO."""
    known = F.create_map(*(F.lit(x) for (p, q), kind in pairs.items() for x in (f"{p}\x1f{q}", kind)))
    of = lambda x, y: F.try_element_at(known, F.concat(x, F.lit("\x1f"), y))
    return F.coalesce(of(a, b), of(b, a), F.lit("RELATED_TO"))


def array_add(c: Column, value: Column) -> Column:
    """F14"""
    return F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.array(value))


def array_drop(c: Column, value) -> Column:
    """F14"""
    return F.array_remove(F.coalesce(c, F.array().cast("array<string>")), value)


def json_object(c: Column) -> Column:
    """from the first brace to the last, without code fences around."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def parse_json_lenient(c: Column, schema: str = "map<string,string>") -> Column:
    """F15"""
    return F.coalesce(F.from_json(c, schema), F.from_json(json_object(c), schema))


def merge_maps(a: Column, b: Column) -> Column:
    """F16: keys of ``b`` win."""
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(kept, b))


def relative_time(then: Column, now: Column) -> Column:
    """F17"""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    some = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f" {unit}"), F.when(n.cast("long") == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(s < 60, "just now").when(s < 3600, some(F.floor(s / 60), "minute")).when(s < 86400, some(F.floor(s / 3600), "hour")).otherwise(some(F.floor(s / 86400), "day"))


def embed_text(name: Column, kind: Column, description: Column) -> Column:
    """F19"""
    return F.concat(F.coalesce(name, F.lit("")), F.lit(". Type: "), F.coalesce(kind, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))


def clean_label(c: Column) -> Column:
    """P5: without the folder suffix; Unknown when empty."""
    out = F.substring_index(c, "_F_", 1)
    return F.when(out.isNull() | (out == ""), F.lit("Unknown")).otherwise(out)


def effective_type(labels: Column, explicit: Column, priority: tuple[str, ...] = PRIORITY_LABELS, system: tuple[str, ...] = SYSTEM_LABELS) -> Column:
    """The explicit type, else of the domain labels (no system label, none of a folder) a priority label or the longest
    (the first of several), else the first label that is no system label, else the first; cleaned like ``clean_label``."""
    own = F.filter(labels, lambda x: ~x.isin(*system))
    domain = F.filter(own, lambda x: ~x.startswith("F_"))
    first = F.get(F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(domain, p)), F.lit(0))
    longest = F.get(F.filter(domain, lambda x: F.length(x) == F.array_max(F.transform(domain, lambda y: F.length(y)))), F.lit(0))
    return clean_label(F.coalesce(F.nullif(explicit, F.lit("")), first, longest, F.get(own, F.lit(0)), F.get(labels, F.lit(0)), F.lit("Unknown")))


def display_name(values: list[Column], kind: Column, id_: Column) -> Column:
    """The first value under 100 characters that doesn't look like an id (over 30 characters with four dashes, or letters and
    digits only); else the type, unless it is Entity or Unknown; else the id, of over 20 characters its first 8; else Unknown."""
    looks = lambda v: (F.length(v) > 30) & ((F.length(v) - F.length(F.replace(v, F.lit("-"), F.lit(""))) >= 4) | v.rlike(r"^[\p{L}\p{N}]+$"))
    shown = (F.when((v != "") & (F.length(v) < 100) & ~looks(v), v) for v in values)
    return F.coalesce(*shown, F.when((kind != "") & ~kind.isin("Entity", "Unknown"), kind), F.when(F.length(id_) > 20, F.substring(id_, 1, 8)).when(id_ != "", id_), F.lit("Unknown"))
