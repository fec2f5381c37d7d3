"""Identity: chunk and point ids, hashes, collection names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The DNS namespace of RFC 4122, as hex digits.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def path_chunk_id(path: Column, index: Column) -> Column:
    """path__chunk_index, with forward slashes and none in front."""
    return F.concat(F.regexp_replace(F.translate(path, "\\", "/"), "^/+", ""), F.lit("__chunk_"), index.cast("string"))


def hashed_chunk_id(path: Column, index: Column, text: Column | None = None) -> Column:
    parts = [path, index.cast("string")] + ([] if text is None else [text])
    return F.substring(text_hash(F.concat_ws("::", *parts)), 1, 16)


def point_id(name: Column) -> Column:
    """UUID version 5 of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def slug(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def collection_name(prefix: Column, model: Column, dims: Column) -> Column:
    return F.concat_ws("_", prefix, slug(model), dims.cast("string"))


def module_id(name: Column) -> Column:
    return F.lower(F.translate(name, " -", "__"))


def all_collection_names(model: Column, dims: Column, kinds: tuple[str, ...] = ("unified", "examples")) -> Column:
    """A map from each kind to its collection's name."""
    return F.create_map(*[x for k in kinds for x in (F.lit(k), collection_name(F.lit(k), model, dims))])
