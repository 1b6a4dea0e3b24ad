"""CycloneDX documents of packages with their binaries and findings, in ordered parts of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a part, and the name that properties and the tool carry.
PART, TOOL = 1000, "riskloom"


def _property(name: str, value: Column) -> Column:
    return F.struct(F.lit(f"{TOOL}:{name}").alias("name"), value.cast("string").alias("value"))


def _put_together(most: int | None):
    """Joins ordered rows (key, section, text) to (key, part, text): parts of a section's `most` entries, or whole documents.

    Entries of a section are joined by commas; every part of a section but its first begins with one.  A package's head is
    its first entry: what follows no head belongs to no package.  Of a task's rows only a batch and what is open are held.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # of the last row: key, section and number in it, whether its package is known, and its part
        last, section, at, known, part = None, None, -1, False, -1
        held = None  # what is open: key, part and texts

        def closed():
            key, n, of = held
            return pa.RecordBatch.from_arrays([key, pa.array([n], "int32"), pa.array(["".join(of)], texts.type)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            (keys, sections, texts), i = batch.columns, np.arange(batch.num_rows)
            names = [batch.schema.names[0], "part", "text"]
            code, sections = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), sections.to_numpy()
            other = np.r_[last is None or last[0] != keys[0].as_py(), code[1:] != code[:-1]]
            begun = other | np.r_[sections[0] != section, sections[1:] != sections[:-1]]
            # rows before the first beginning go on with what is open
            first = np.maximum.accumulate(np.where(begun, i, -1 - at))
            numbers = i - first
            head = np.maximum.accumulate(np.where(other, i, -1))
            counted = np.where(head < 0, known, sections[head] == 0)
            new = other if most is None else begun | (numbers % most == 0)
            count = np.cumsum(new)
            parts = np.where(head < 0, part + count, count - count[head])
            last, section, at, known, part = (keys[-1].as_py(),), sections[-1], numbers[-1], counted[-1], parts[-1]
            texts = pc.binary_join_element_wise(pc.if_else(pa.array(numbers > 0), pa.scalar(",", texts.type), pa.scalar("", texts.type)), texts, pa.scalar("", texts.type))
            if not counted.all():
                kept = pa.array(counted)
                keys, texts, new, parts = keys.filter(kept), texts.filter(kept), new[counted], parts[counted]
            if not len(new):
                continue
            starts = np.flatnonzero(new)
            until = starts[0] if len(starts) else len(new)
            if until:
                held[2].extend(texts.slice(0, until).to_pylist())
            if not len(starts):
                continue
            if held:
                yield closed()
            if len(starts) > 1:
                offsets = pa.array(starts, "int32")
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), "")
                yield pa.RecordBatch.from_arrays([keys.take(offsets[:-1]), pa.array(parts[starts[:-1]], "int32"), joined], names)
            held = (keys.slice(starts[-1], 1), parts[starts[-1]], texts.slice(starts[-1]).to_pylist())
        if held:
            yield closed()

    return run


def _entries(packages: DataFrame, binaries: DataFrame, behaviours: DataFrame, findings: DataFrame, key: str, as_of: str) -> DataFrame:
    """Ordered rows (key, section, text) of documents, all of a package in one task.

    Entries are dealt by package once, as columns, and written as texts where they lie in order.  Behaviours find their
    packages by a hash of the binary, so binaries aren't dealt by it; one that has another's hash meets no binary there.
    """
    ref = F.concat(F.lit("pkg:"), F.col("p.ecosystem"), F.lit("/"), F.col("p.name"), F.lit("@"), F.col("p.version"))
    hashed = F.shiftrightunsigned(F.xxhash64("binary_id"), 24)
    heads = packages.select(key, F.lit(0).alias("section"), F.struct("ecosystem", "name", "version", "risk_score", "risk_level").alias("p"))
    rows = heads.unionByName(packages.select(key, F.explode(F.array(F.lit(2), F.lit(4))).alias("section")), True)
    # digests of lower-case hex travel as bytes
    hexed = F.col("sha256").rlike("^([0-9a-f]{2})+$")
    told = binaries.filter(F.col(key).isNotNull())
    rows = rows.unionByName(told.select(key, F.lit(1).alias("section"), "binary_id", F.struct("filename", F.when(hexed, F.unhex("sha256")).alias("digest"), F.when(~hexed, F.col("sha256")).alias("sha256"), "risk_score", "risk_level", "format", "architecture").alias("b")), True)
    one = F.struct(F.concat(F.lit(f"{TOOL}:behavior:"), "behaviour").alias("name"), F.col("details").alias("value"))
    shown = behaviours.filter("binary_id is not null").select("binary_id", hashed.alias("h"), one.alias("one")).repartition("h")
    shown = shown.groupBy("h", "binary_id").agg(F.array_sort(F.collect_list("one")).alias("shown"))
    shown = told.filter("binary_id is not null").select(key, hashed.alias("h")).join(shown.hint("merge"), "h")
    rows = rows.unionByName(shown.select(key, F.lit(1).alias("section"), "binary_id", "shown"), True)
    found = findings.filter(F.col(key).isNotNull())
    rows = rows.unionByName(found.select(key, F.lit(3).alias("section"), "binary_id", "title", "description", "severity", "recommendation"), True)
    # a binary's behaviours come before it; numbers, behaviours and texts are written in one order
    order = [F.col(c) for c in ("entry", "title", "description", "severity", "recommendation")]
    by = Window.partitionBy(key, "section", "binary_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition(key).withColumn("entry", F.col("shown").isNull())
    rows = rows.select("*", (F.row_number().over(by) - 1).alias("i"), F.first("shown", True).over(by).alias("shows"))
    rows = rows.sortWithinPartitions(key, "section", "binary_id", *order).filter("entry")

    uuid = F.regexp_replace(F.md5(F.concat(ref, F.lit(as_of))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    own = F.array(_property("ecosystem", F.col("p.ecosystem")), _property("riskScore", F.col("p.risk_score")), _property("riskLevel", F.col("p.risk_level")))
    component = F.struct(F.lit("library").alias("type"), ref.alias("bom-ref"), "p.name", "p.version", ref.alias("purl"), own.alias("properties"))
    tool = F.struct(F.array(F.struct(F.lit("application").alias("type"), F.lit(TOOL).alias("name"))).alias("components"))
    head = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.concat(F.lit("urn:uuid:"), uuid).alias("serialNumber"), F.lit(1).alias("version"), F.struct(F.lit(as_of).alias("timestamp"), tool.alias("tools"), component.alias("component")).alias("metadata"))
    # the head's closing brace is left off, and put at the end
    head = F.concat(F.regexp_replace(F.to_json(head), r"\}$", ""), F.lit(',"components":['))
    none = F.array().cast("array<struct<name:string,value:string>>")
    told = F.concat(F.coalesce("shows", none), F.array(*[_property(n, F.col(c)) for n, c in (("riskScore", "b.risk_score"), ("riskLevel", "b.risk_level"), ("format", "b.format"), ("architecture", "b.architecture"))]))
    digest = F.coalesce(F.lower(F.hex("b.digest")), "b.sha256")
    hashes = F.when(digest.isNotNull(), F.array(F.struct(F.lit("SHA-256").alias("alg"), digest.alias("content")))).otherwise(F.array().cast("array<struct<alg:string,content:string>>"))
    file = F.struct(F.lit("file").alias("type"), F.col("binary_id").alias("bom-ref"), F.col("b.filename").alias("name"), hashes.alias("hashes"), told.alias("properties"))
    name = F.concat_ws("-", "binary_id", F.col("i").cast("string"))
    rating = F.array(F.struct(F.col("severity"), F.struct(F.lit("other").alias("value")).alias("method")))
    vulnerability = F.struct(F.concat(F.lit("vuln-"), name).alias("bom-ref"), F.concat(F.lit("RLM-"), name).alias("id"), "description", F.col("title").alias("detail"), "recommendation", F.struct(F.lit(TOOL).alias("name")).alias("source"), rating.alias("ratings"), F.array(F.struct(F.col("binary_id").alias("ref"))).alias("affects"))
    text = F.when(F.col("section") == 0, head).when(F.col("section") == 1, F.to_json(file)).when(F.col("section") == 2, '],"vulnerabilities":[').when(F.col("section") == 3, F.to_json(vulnerability)).otherwise("]}")
    return rows.select(key, "section", text.alias("text"))


def document_parts(packages: DataFrame, binaries: DataFrame, behaviours: DataFrame, findings: DataFrame, key: str, as_of: str) -> DataFrame:
    """key, part (from 0) and text: a package's document is its texts in order.

    packages: key, ecosystem, name, version, risk_score, risk_level; binaries: key, binary_id, filename, sha256,
    risk_score, risk_level, format, architecture; behaviours: binary_id, behaviour, details, at most a few a binary;
    findings: key, binary_id, title, description, recommendation, severity.  A package of any number of binaries or
    findings never meets in one value.  Findings are numbered within their package's binary by title, then description.
    """
    rows = _entries(packages, binaries, behaviours, findings, key, as_of)
    return rows.mapInArrow(_put_together(PART), f"`{key}` {rows.schema[key].dataType.simpleString()}, part int, text string")


def documents(packages: DataFrame, binaries: DataFrame, behaviours: DataFrame, findings: DataFrame, key: str, as_of: str) -> DataFrame:
    """key and document of each package, as document_parts() has them, for packages whose documents are small enough for one value."""
    rows = _entries(packages, binaries, behaviours, findings, key, as_of)
    whole = rows.mapInArrow(_put_together(None), f"`{key}` {rows.schema[key].dataType.simpleString()}, part int, text string")
    return whole.select(key, F.col("text").alias("document"))
