"""Imaging mass spectrometry: an XML part that describes spectra and a binary part that holds them.

``spark.read.format("imzml").load(path)`` gives a row for each spectrum. The
driver reads the XML; tasks read their spectra's bytes. The options ``first``
and ``last`` (of ``idx``) and ``z`` prune spectra before they are read. Filters
aren't pushed down: Spark keeps what a Python source made of a filter with the
table, so a DataFrame read again without the filter would still be filtered.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.objects import open_file

#: Accessions of the controlled vocabulary.
PRECISION = {"MS:1000521": "f", "MS:1000523": "d", "MS:1000519": "i", "MS:1000522": "l", "IMS:1000141": "i", "IMS:1000142": "l"}
NUMPY = {"f": "<f4", "d": "<f8", "i": "<i4", "l": "<i8"}
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
OFFSET, LENGTH, ENCODED = "IMS:1000102", "IMS:1000103", "IMS:1000104"
POSITION_X, POSITION_Y, POSITION_Z = "IMS:1000050", "IMS:1000051", "IMS:1000052"
META = {
    "max count of pixels x": "IMS:1000042", "max count of pixels y": "IMS:1000043", "max dimension x": "IMS:1000044", "max dimension y": "IMS:1000045",
    "pixel size x": "IMS:1000046", "pixel size y": "IMS:1000047", "matrix solution concentration": "MS:1000835", "wavelength": "MS:1000843", "focus diameter x": "MS:1000844",
    "focus diameter y": "MS:1000845", "pulse energy": "MS:1000846", "pulse duration": "MS:1000847", "attenuation": "MS:1000848",
}
SCHEMA = "idx int, x int, y int, z int, mz array<double>, intensity array<double>"
SPECTRA_EACH = 500


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


@dataclass
class Layout:
    """What the XML says: for each spectrum coordinates, offsets and lengths of both arrays; types; scalars."""

    coordinates: list[tuple[int, int, int]] = field(default_factory=list)
    mz: list[tuple[int, int] | None] = field(default_factory=list)
    intensity: list[tuple[int, int] | None] = field(default_factory=list)
    mz_type: str = "d"
    intensity_type: str = "f"
    meta: dict[str, float] = field(default_factory=dict)
    groups: list[dict[str, list[str]]] = field(default_factory=list)


def unwrapped(offsets: list[int]) -> list[int]:
    """Offsets that were written as signed 32-bit numbers, with 2**32 added at each step to below zero."""
    if not any(x < 0 for x in offsets):
        return offsets
    out, add, was = [], 0, 0
    for x in offsets:
        if x < 0 <= was:
            add += 1 << 32
        out.append(x + add)
        was = x
    return out


def parse(path: str) -> Layout:
    layout, groups = Layout(), {}
    kinds: dict[str, str] = {}
    with open_file(path) as f:
        above: list[ET.Element] = []
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(e)
                continue
            above.pop()
            tag = local(e.tag)
            if tag == "referenceableParamGroup":
                names = {c.get("accession") for c in e if local(c.tag) == "cvParam"}
                groups[e.get("id")] = names
                kind = "mz" if MZ_ARRAY in names else "intensity" if INTENSITY_ARRAY in names else None
                if kind:
                    kinds[e.get("id")] = kind
                    for a in names & set(PRECISION):
                        setattr(layout, f"{kind}_type", PRECISION[a])
            elif tag == "cvParam":
                for name, accession in META.items():
                    if e.get("accession") == accession and e.get("value"):
                        layout.meta.setdefault(name, float(e.get("value")))
            elif tag == "spectrum":
                spectrum(e, layout, kinds)
                above[-1].remove(e)  # nothing of a read spectrum stays
    for name in ("mz", "intensity"):
        arrays = getattr(layout, name)
        known = iter(unwrapped([a[0] for a in arrays if a]))
        setattr(layout, name, [(next(known), a[1]) if a else (0, 0) for a in arrays])
    return layout


def spectrum(e: ET.Element, layout: Layout, kinds: dict[str, str]) -> None:
    at = {POSITION_X: None, POSITION_Y: None, POSITION_Z: None}
    ids: dict[str, list[str]] = {"params": [], "instruments": [], "processing": []}
    for c in e.iter():
        if local(c.tag) == "cvParam" and c.get("accession") in at:
            at[c.get("accession")] = int(c.get("value"))
        elif local(c.tag) == "referenceableParamGroupRef":
            ids["params"].append(c.get("ref"))
        for name, key in (("instrumentConfigurationRef", "instruments"), ("dataProcessingRef", "processing")):
            if c.get(name):
                ids[key].append(c.get(name))
    layout.coordinates.append((at[POSITION_X], at[POSITION_Y], 1 if at[POSITION_Z] is None else at[POSITION_Z]))
    layout.groups.append(ids)
    found: dict[str, tuple[int, int]] = {}  # a spectrum without an array has an empty one
    for array in (c for c in e.iter() if local(c.tag) == "binaryDataArray"):
        value = {c.get("accession"): c.get("value") for c in array if local(c.tag) == "cvParam"}
        refs = [c.get("ref") for c in array if local(c.tag) == "referenceableParamGroupRef"]
        kind = next((kinds[r] for r in refs if r in kinds), "mz" if MZ_ARRAY in value else "intensity")
        if value.get(OFFSET) is not None and value.get(LENGTH) is not None:
            found[kind] = (int(value[OFFSET]), int(value[LENGTH]))
    layout.mz.append(found.get("mz"))
    layout.intensity.append(found.get("intensity"))


def array_at(f, offset: int, length: int, code: str) -> np.ndarray:
    kind = np.dtype(NUMPY[code])
    f.seek(offset)
    return np.frombuffer(f.read(length * kind.itemsize), kind)


@dataclass
class Spectra(InputPartition):
    """Picklable: what a task needs to read its spectra."""

    ibd: str
    rows: list[tuple]
    mz_type: str
    intensity_type: str


class ImzmlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.ibd = options.get("ibd") or re.sub(r"(?i)\.imzml$", ".ibd", self.path)
        self.each = int(options.get("spectraPerPartition", SPECTRA_EACH))
        self.first, self.last, self.z = (int(options[k]) if options.get(k) is not None else None for k in ("first", "last", "z"))

    def wanted(self, idx: int, z: int) -> bool:
        return (self.first is None or idx >= self.first) and (self.last is None or idx <= self.last) and (self.z is None or z == self.z)

    def partitions(self):
        layout = parse(self.path)
        rows = [(i, x, y, z, *a, *b) for i, ((x, y, z), a, b) in enumerate(zip(layout.coordinates, layout.mz, layout.intensity)) if self.wanted(i, z)]
        return [Spectra(self.ibd, rows[k : k + self.each], layout.mz_type, layout.intensity_type) for k in range(0, len(rows), self.each)] or [Spectra(self.ibd, [], "d", "f")]

    def read(self, part):
        if not part.rows:
            return
        with open_file(part.ibd) as f:
            for i, x, y, z, mo, mn, io, n in part.rows:
                mz = array_at(f, mo, mn, part.mz_type).astype(np.float64)
                intensity = array_at(f, io, n, part.intensity_type).astype(np.float64)
                yield (i, x, y, z, mz.tolist(), intensity.tolist())


class ImzmlSource(DataSource):
    @classmethod
    def name(cls):
        return "imzml"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ImzmlReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImzmlSource)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A row for each spectrum; options: first, last, z, ibd, spectraPerPartition."""
    register(spark)
    return spark.read.format("imzml").options(**options).load(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """name, value: scan and instrument scalars."""
    return spark.createDataFrame(list(parse(path).meta.items()), "name string, value double")


def browse(spark: SparkSession, path: str) -> DataFrame:
    """idx and the ids of parameter groups, instruments and processings of each spectrum."""
    rows = [(i, g["params"], g["instruments"], g["processing"]) for i, g in enumerate(parse(path).groups)]
    return spark.createDataFrame(rows, "idx int, params array<string>, instruments array<string>, processing array<string>")


def write(path: str, spectra: list[tuple], mz_type: str = "d", intensity_type: str = "f") -> None:
    """A small file pair from (x, y, z or None, mz values, intensities), for tests and examples."""
    code = {v: k for k, v in PRECISION.items() if k.startswith("MS:")}
    out, body = [], bytearray(16)
    for i, (x, y, z, mz, intensity) in enumerate(spectra):
        arrays = ""
        for kind, values, c in (("mz", mz, mz_type), ("in", intensity, intensity_type)):
            arrays += f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{kind}"/><cvParam accession="{OFFSET}" value="{len(body)}"/><cvParam accession="{LENGTH}" value="{len(values)}"/><binary/></binaryDataArray>'
            body += np.array(values, NUMPY[c]).tobytes()
        scan = "".join(f'<cvParam accession="{a}" value="{v}"/>' for a, v in ((POSITION_X, x), (POSITION_Y, y), (POSITION_Z, z)) if v is not None)
        out.append(f'<spectrum id="s{i}" index="{i}"><scanList><scan instrumentConfigurationRef="ic">{scan}</scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
    groups = "".join(f'<referenceableParamGroup id="{k}"><cvParam accession="{a}"/><cvParam accession="{code[c]}"/></referenceableParamGroup>' for k, a, c in (("mz", MZ_ARRAY, mz_type), ("in", INTENSITY_ARRAY, intensity_type)))
    xml = f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList>{groups}</referenceableParamGroupList><scanSettings><cvParam accession="{META["pixel size x"]}" value="50"/></scanSettings><run><spectrumList>{"".join(out)}</spectrumList></run></mzML>'
    with open(path, "w") as f:
        f.write(xml)
    with open(re.sub(r"(?i)\.imzml$", ".ibd", path), "wb") as f:
        f.write(bytes(body))


__all__ = ["read", "metadata", "browse", "parse", "register", "write", "unwrapped"]
