"""Rewriting file locations from one archive root to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uri_position(uri: Column, src: Column, *, bounded: bool = False) -> Column:
    """1-based position of the source path in a URI, 0 if it does not occur."""
    if bounded:
        return F.position(F.concat(src, F.lit("/")), F.concat(uri, F.lit("/")))
    return F.position(src, uri)


def rewrite_uri(uri: Column, src: Column, dst: Column, *, bounded: bool = False) -> Column:
    """Replace the first occurrence of ``src`` in ``uri`` by ``dst``, literally.

    A URI without the source path is returned unchanged; :func:`uri_mismatch` tells them
    apart. The match is neither anchored nor bound to a path segment, so ``/a/p1`` also
    matches in ``/a/p10/x``; ``bounded=True`` requires a segment end after the match.
    """
    at = uri_position(uri, src, bounded=bounded)
    return F.when(at > 0, F.overlay(uri, dst, at, F.length(src))).otherwise(uri)


def uri_mismatch(uri: Column, src: Column, *, bounded: bool = False) -> Column:
    """True for a URI that lies outside the source path; null URIs are fine."""
    return uri.isNotNull() & (uri_position(uri, src, bounded=bounded) == 0)
