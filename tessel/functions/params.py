"""Parameter strings such as M=16,efC=200,ef=64 and the families they belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(params: Column | str) -> Column:
    """Map of the keys and values."""
    return F.str_to_map(params, F.lit(","), F.lit("="))


def number(params: Column | str, key: str) -> Column:
    return F.nullif(F.regexp_extract(params, rf"(?:^|,){key}=([0-9]+)", 1), F.lit("")).cast("int")


def block(params: Column | str) -> Column:
    """What one build is shared by: the parameters without those of the search."""
    return F.regexp_replace(params, r",(ef|nprobe)=[0-9]+", "")


def hnsw_name(m: Column, efc: Column, ef: Column, nearest: Column | None = None) -> Column:
    """Short name; the selection is told only where it is not the usual heuristic."""
    suffix = F.lit("") if nearest is None else F.when(nearest, ",sel=nearestM").otherwise("")
    return F.concat(F.lit("M="), m.cast("string"), F.lit(",efC="), efc.cast("string"), F.lit(",ef="), ef.cast("string"), suffix)


def ivfpq_name(nlist: Column, m: Column, nprobe: Column, plus: Column | None = None) -> Column:
    suffix = F.lit("") if plus is None else F.when(plus, ",init=kmeans++").otherwise("")
    return F.concat(F.lit("nlist="), nlist.cast("string"), F.lit(",m="), m.cast("string"), F.lit(",nprobe="), nprobe.cast("string"), suffix)


def is_hnsw(index: Column) -> Column:
    return F.lower(index).startswith("hnsw")


def is_ivfpq(index: Column) -> Column:
    return F.lower(index).startswith("ivfpq") | F.lower(index).startswith("ivf-pq")


def check_divides(dim: int, m: int) -> None:
    if m < 1 or dim % m:
        raise ValueError(f"{m} subspaces don't divide {dim} dimensions")
