"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from ..plans.registry import Registry
from ..sources.tables import table
from . import cross_split, leakage, mixing, residue, sampling, splits, turns
from .sql import SQL

REGISTRY = Registry()


def _add(name, f):
    REGISTRY.query(name, SQL.get(name))(f)


_add("p1_found", lambda s, d: splits.tied_speakers(table(s, d, "samples")))
_add("p1_splits", lambda s, d: splits.assign_splits(table(s, d, "samples"), table(s, d, "dialect_map")))
_add("p1_report", lambda s, d: splits.split_report(splits.assign_splits(table(s, d, "samples"), table(s, d, "dialect_map"))))
_add("p1_check", lambda s, d: splits.split_check(splits.assign_splits(table(s, d, "samples"), table(s, d, "dialect_map")), table(s, d, "samples")))
_add("p2_found", lambda s, d: turns.speaker_turns(table(s, d, "raw_transcripts")))
_add("p2_turns", lambda s, d: turns.turn_texts(table(s, d, "raw_transcripts")))
_add("p4_found", lambda s, d: cross_split.overlapping_pairs(table(s, d, "samples")))
_add("p4_report", lambda s, d: cross_split.overlap_report(table(s, d, "samples")))
_add("p5_found", lambda s, d: sampling.unmet_targets(table(s, d, "samples"), table(s, d, "sample_targets"), table(s, d, "dialect_map")))
_add("p5_sample", lambda s, d: sampling.draw(table(s, d, "samples"), table(s, d, "sample_targets"), table(s, d, "dialect_map")))
_add("p5_report", lambda s, d: sampling.sample_report(table(s, d, "samples"), table(s, d, "sample_targets"), table(s, d, "dialect_map")))
_add("p5_met", lambda s, d: sampling.sample_report(table(s, d, "samples"), table(s, d, "sample_targets"), table(s, d, "dialect_map")).select("plan_id", "category", "cat_value", "n_have", "n_want", "met"))
_add("p5_shares", lambda s, d: sampling.sample_report(table(s, d, "samples"), table(s, d, "sample_targets"), table(s, d, "dialect_map"), keep_shares=True))
_add("p6_found", lambda s, d: leakage.leaking_documents(table(s, d, "documents"), table(s, d, "eval_items")))
_add("p6_items", lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")))
_add("p7_found", lambda s, d: mixing.short_sources(table(s, d, "documents"), table(s, d, "mix_targets")))
_add("p7_mix", lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")))
_add("p7_report", lambda s, d: mixing.mix_report(table(s, d, "documents"), table(s, d, "mix_targets")))
_add("p8_found", lambda s, d: residue.residual_documents(table(s, d, "documents")))
_add("p8_report", lambda s, d: residue.residue_report(table(s, d, "documents")))
