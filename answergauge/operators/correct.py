"""The bounded correction of a score: figures, identifiers and refusals of an answer against the truth.

It only lowers a score. A figure that the answer leaves out costs nothing, one that it states differently does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge import schema
from answergauge.functions import scan, text, vectors

ASCII_WHITE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class DetectorConfig:
    """Settings of the detectors; the defaults are the fixed values of the shipped scorer."""

    max_correction: float = 0.12
    numeric_weight: float = 0.08
    ident_weight: float = 0.06
    refusal_weight: float = 0.06
    rel_tolerance: float = 0.005
    max_headline: int = 2
    salience_floor: int = 3
    small_int_cutoff: float = 10.0
    flood_threshold: int = 48
    hex_prefix_min: int = 24
    max_truth_numbers: int = 0  # 0: no limit; else a truth with more numbers isn't checked
    check_dates: bool = False
    cross_type_fallback: bool = True
    refusal_window: int = text.REFUSAL_WINDOW
    markers: tuple[str, ...] = text.REFUSALS


def refuses(data: bytes, cfg: DetectorConfig) -> bool:
    head = data[: cfg.refusal_window].lower()
    return any(m.encode() in head for m in cfg.markers)


def equal(a: float, b: float, tolerance: float) -> bool:
    d = abs(a - b)
    m = max(abs(a), abs(b))
    return d == 0 or (d < 1e-9 if m < 1e-9 else d <= tolerance * m)


def headline(found: list[scan.Number], cfg: DetectorConfig) -> list[scan.Number]:
    """The figures that a truth is about: those with a sign of money or percent, else the largest."""
    if len(found) > cfg.salience_floor:
        whole = lambda n: n.value == np.rint(n.value)
        aside = lambda n: whole(n) and (1900 <= n.value <= 2100 or 0 <= n.value < cfg.small_int_cutoff)
        found = [n for n in found if n.currency or n.percent or not aside(n)] or found
    typed = [n for n in found if n.currency or n.percent]
    return (typed or sorted(found, key=lambda n: (-abs(n.value), n.start)))[: cfg.max_headline]


def same_identifier(a: scan.Ident, b: scan.Ident, cfg: DetectorConfig) -> bool:
    """Equal, or long hex strings of which one begins the other."""
    if a.kind != b.kind or a.kind != "hex":
        return a.kind == b.kind and a.text == b.text
    n = min(len(a.text), len(b.text))
    return a.text == b.text or n - 2 >= cfg.hex_prefix_min and a.text[:n] == b.text[:n]


def numeric_verdict(truth: list[scan.Number], answer: list[scan.Number], cfg: DetectorConfig) -> tuple[int, int]:
    """(figures that the answer states differently, figures that it has a counterpart for)."""
    if not answer or cfg.max_truth_numbers and len(truth) > cfg.max_truth_numbers:
        return 0, 0
    against = checked = 0
    for h in headline(truth, cfg):
        peers = [n for n in answer if (n.currency, n.percent) == (h.currency, h.percent)]
        if not peers and cfg.cross_type_fallback:
            peers = answer
        if not peers or len(peers) > cfg.flood_threshold:
            continue
        checked += 1
        against += not any(equal(h.value, n.value, cfg.rel_tolerance) for n in peers)
    return against, checked


def analyse_one(truth: str | None, answer: str | None, cfg: DetectorConfig) -> dict:
    """The correction of one pair."""
    gt, ma = (truth or "").encode(), (answer or "").encode()
    f32, zero = np.float32, np.float32(0)
    out = {"total": zero, "numeric": zero, "ident": zero, "refusal": zero, "gt_refused": False, "numeric_coverage": None, "ident_coverage": None}
    if not ma.strip(ASCII_WHITE):
        return out
    if refuses(gt, cfg):
        return out | {"gt_refused": True}
    if refuses(ma, cfg):
        out["refusal"] = -f32(cfg.refusal_weight)
    gt_ids, ma_ids = scan.identifiers(gt), scan.identifiers(ma)
    asked = [g for g in gt_ids if cfg.check_dates or g.kind != "date"]
    if asked:
        coverage = f32(sum(any(same_identifier(g, m, cfg) for m in ma_ids) for g in asked)) / f32(len(asked))
        out["ident_coverage"] = coverage
        out["ident"] = -f32(cfg.ident_weight) * (f32(1) - coverage)
    against, checked = numeric_verdict(scan.numbers(gt, gt_ids), scan.numbers(ma, ma_ids), cfg)
    if checked:
        out["numeric_coverage"] = f32(checked - against) / f32(checked)
        out["numeric"] = -f32(cfg.numeric_weight) * (f32(against) / f32(checked))
    total = out["numeric"] + out["ident"] + out["refusal"]
    out["total"] = min(zero, max(-f32(cfg.max_correction), total))
    return out


def analyse_plain(truth: Column, answer: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """analyse() by analyse_one(), a row at a time: the second implementation, to hold the first against."""

    @F.pandas_udf(schema.CORRECTION)
    def run(truths: pd.Series, answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse_one(t, a, cfg) for t, a in zip(truths, answers, strict=True)], columns=schema.CORRECTION.names)

    return run(truth, answer)


def detect(truth: Column, answer: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """What weigh() needs of a pair, whatever the weights: blank, gt_refused, refused, and counts of figures and identifiers.

    Python sees only pairs that can have any of them: no blank answer, no refusal as the truth, a digit in the truth.
    """

    @F.pandas_udf(schema.DETECTED)
    def run(truths: pd.Series, answers: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(truths), 4), np.int32)
        for k, (t, a) in enumerate(zip(truths, answers, strict=True)):
            if t is not None and a is not None:
                out[k] = _counts(t.encode(), a.encode(), cfg)
        return pd.DataFrame(out, columns=schema.DETECTED.names)

    blank, gt_refused = text.is_blank(answer), text.is_refusal(truth, cfg.markers, cfg.refusal_window)
    scanned = ~blank & ~gt_refused & F.coalesce(truth, F.lit("")).rlike("[0-9]")
    counts = run(F.when(scanned, truth), F.when(scanned, answer))
    return F.struct(blank.alias("blank"), gt_refused.alias("gt_refused"), text.is_refusal(answer, cfg.markers, cfg.refusal_window).alias("refused"), counts.alias("counts"))


def _counts(truth: bytes, answer: bytes, cfg: DetectorConfig) -> tuple[int, int, int, int]:
    gt_ids, ma_ids = scan.identifiers(truth), scan.identifiers(answer)
    asked = [g for g in gt_ids if cfg.check_dates or g.kind != "date"]
    hits = sum(any(same_identifier(g, m, cfg) for m in ma_ids) for g in asked)
    return *numeric_verdict(scan.numbers(truth, gt_ids), scan.numbers(answer, ma_ids), cfg), hits, len(asked)


def weigh(found: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """The correction of what detect() found, in float32 steps; coverages are null where nothing was checked."""
    f32 = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("float")
    share = lambda a, b: F.when(b > 0, f32(f32(a) / f32(b)))
    zero = f32(0)
    counts = found["counts"]
    looked = ~found["blank"] & ~found["gt_refused"]
    ident_coverage = F.when(looked, share(counts["hits"], counts["asked"]))
    numeric_coverage = F.when(looked, share(counts["checked"] - counts["against"], counts["checked"]))
    numeric = F.when(looked & (counts["checked"] > 0), zero - f32(cfg.numeric_weight) * share(counts["against"], counts["checked"])).otherwise(zero)
    ident = F.when(ident_coverage.isNotNull(), zero - f32(cfg.ident_weight) * (f32(1) - ident_coverage)).otherwise(zero)
    refusal = F.when(looked & found["refused"], zero - f32(cfg.refusal_weight)).otherwise(zero)
    total = F.least(zero, F.greatest(zero - f32(cfg.max_correction), numeric + ident + refusal))
    parts = {"total": total, "numeric": numeric, "ident": ident, "refusal": refusal, "gt_refused": ~found["blank"] & found["gt_refused"], "numeric_coverage": numeric_coverage, "ident_coverage": ident_coverage}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def analyse(truth: Column, answer: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """The correction of each row, a struct; coverages are null where nothing was checked."""
    # Within a lambda what was detected is one value, not as many expressions as it is used.
    return F.get(F.transform(F.array(detect(truth, answer, cfg)), lambda d: weigh(d, cfg)), F.lit(0))


def apply(baseline: Column, total: Column) -> Column:
    """The corrected score: added in float32, kept within [0, 1]."""
    return vectors.clamp01((baseline.cast("float") + total.cast("float")).cast("float").cast("double")).cast("double")


def fired(correction: Column) -> Column:
    return correction["total"] != 0


def headline_figures(truth: Column, cfg: DetectorConfig = DetectorConfig()) -> Column:
    """The figures that each truth is held to."""

    @F.pandas_udf(schema.T.ArrayType(schema.NUMBER))
    def run(truths: pd.Series) -> pd.Series:
        found = [(t or "").encode() for t in truths]
        return pd.Series([[n._asdict() for n in headline(scan.numbers(t, scan.identifiers(t)), cfg)] for t in found], dtype=object)

    return run(truth)
