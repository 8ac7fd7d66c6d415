"""Small files that a bank is made of and reported in: frames, dilemma records, balance and candidate reports. One document each, so the driver writes them."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec


def write_atomically(path: str, body: str, overwrite: bool = True) -> None:
    """The whole file or none; one that is there is an error unless it may be replaced."""
    if not overwrite and os.path.exists(path):
        raise FileExistsError(path)
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(body)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_json(path: str, doc: dict, overwrite: bool = True, sort_keys: bool = False) -> None:
    write_atomically(path, json.dumps(doc, indent=2, ensure_ascii=False, sort_keys=sort_keys) + "\n", overwrite)


def frame_document(encoder: dict, axis: list[float], mean: list[float], counts: dict, created_at: str, generator_version: str) -> dict:
    """A measurement frame: axis and mean as big-endian doubles, the mean's diagnostics, and the id of the content."""
    if len(axis) != len(mean):
        raise ValueError(f"axis of {len(axis)} and mean of {len(mean)} components")
    dot, norm, size = sum(a * m for a, m in zip(axis, mean, strict=True)), sum(m * m for m in mean) ** 0.5, sum(a * a for a in axis) ** 0.5
    doc = {
        "generator_version": generator_version, "created_at": created_at, "encoder": encoder, "gender_axis": {"dim": len(axis), "vector_f64_be_hex": codec.encode_f64(axis)},
        "mu_bar": {"dim": len(mean), "vector_f64_be_hex": codec.encode_f64(mean), "norm": norm, "cos_with_axis": dot / (norm * size) if norm and size else 0.0}, "counts": counts,
    }
    return {"frame_id": codec.content_id(doc), **doc}


def read_dilemma(path: str) -> dict:
    """A dilemma record; one that lacks a word, a specification or its scores is an error that names the file."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    for key in ("specification", "target", "neutral_bridge", "stereotypical_bridge", "consensus_ok", "arbiter_scores"):
        if key not in doc:
            raise ValueError(f"{path}: no {key}")
    return doc


def write_dilemma(path: str, record: dict, overwrite: bool = False) -> None:
    """Deterministic bytes; a record that is there stays unless asked otherwise."""
    write_json(path, record, overwrite, sort_keys=True)


def rho_fixture_path(folder: str, frame_id: str) -> str:
    return os.path.join(folder, f"rho_reference_{frame_id[:8]}.json")


def candidates_csv(rows: DataFrame) -> str:
    """(word, specification, weat_set) as CSV with LF, sets joined by semicolons, nulls empty, in the words' order."""
    out = io.StringIO()
    put = csv.writer(out, lineterminator="\n")
    put.writerow(["word", "specification", "weat_set"])
    joined = rows.select("word", F.coalesce("specification", F.lit("")).alias("s"), F.concat_ws(";", "weat_set").alias("w")).orderBy("word")
    for r in joined.toLocalIterator():  # a word list
        put.writerow([r["word"], r["s"], r["w"]])
    return out.getvalue()


def provenance(counts: dict[str, int], excluded: DataFrame, inputs: dict[str, str]) -> dict:
    """Counts of a candidate report, what each reason left out, and digests of its inputs."""
    audit: dict[str, list[str]] = {}
    for r in excluded.where("reason is not null").groupBy("reason").agg(F.array_sort(F.collect_set("word")).alias("ws")).collect():  # a word list
        audit[r["reason"]] = list(r["ws"])
    return {"counts": counts, "excluded": audit, "inputs": {k: hashlib.sha256(open(p, "rb").read()).hexdigest() for k, p in inputs.items()}}


def report_lines(rows: DataFrame, *keys: str) -> list[str]:
    """A report as text: its columns and rows by the keys, nulls as a dash."""
    names = rows.columns
    lines = ["  ".join(names)]
    for r in rows.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).toLocalIterator():
        lines.append("  ".join("-" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in names))
    return lines


def read_encoder_recipe(folder: str) -> dict:
    """Pooling and normalisation of an encoder's snapshot: its list of modules and the pooling module's settings, of which just one mode may be on."""
    with open(os.path.join(folder, "modules.json"), encoding="utf-8") as f:
        modules = json.load(f)
    pooling = [m for m in modules if m["type"].endswith(".Pooling")]
    if len(pooling) != 1:
        raise ValueError(f"{folder}: {len(pooling)} pooling modules")
    with open(os.path.join(folder, pooling[0]["path"], "config.json"), encoding="utf-8") as f:
        config = json.load(f)
    modes = [k.removeprefix("pooling_mode_") for k, v in config.items() if k.startswith("pooling_mode_") and v is True]
    if len(modes) != 1:
        raise ValueError(f"{folder}: {len(modes)} pooling modes are on")
    return {"pooling": modes[0].split("_")[0], "dim": config.get("word_embedding_dimension"), "normalize": any(m["type"].endswith(".Normalize") for m in modules)}


def check_encoder(recipe: dict, pooling: str, dim: int, normalize: bool) -> None:
    """An encoder that pools otherwise, gives vectors of another length, or normalises though the frame says it does not, is an error."""
    if recipe["pooling"] != pooling:
        raise ValueError(f"pools with {recipe['pooling']}, not {pooling}")
    if recipe["dim"] is not None and recipe["dim"] != dim:
        raise ValueError(f"{recipe['dim']} components, not {dim}")
    if recipe["normalize"] and not normalize:
        raise ValueError("normalises, though the frame does not")
