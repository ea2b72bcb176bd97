"""Queries of the media operators over the driver's tables, each beside its SQL."""

from __future__ import annotations

from lumenflow.plans import bitstreams, blocks, entropy, frames, motion, pictures, pixels, planes, streams, wavefront

MODULES = (pixels, blocks, entropy, motion, planes, frames, bitstreams, streams, pictures, wavefront)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
