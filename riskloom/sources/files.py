"""Corpora of files as tables: lockfiles, wheel metadata, binaries.

Files are read with their path; each format is a column expression, so a directory of any size is one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graph import checkpointed

NPM = "packages map<string, struct<version: string, dev: boolean, hasInstallScript: boolean>>, dependencies map<string, struct<version: string, dev: boolean, dependencies: map<string, struct<version: string, dev: boolean>>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every text file below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def lockfile_format(path: Column, content: Column) -> Column:
    """The format by the file's name, else by its content; null if neither tells."""
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name == "package-lock.json", "npm")
        .when(name == "yarn.lock", F.when(content.contains("__metadata:"), "yarn-berry").otherwise("yarn"))
        .when(name == "pnpm-lock.yaml", "pnpm")
        .when(name.rlike(r"^requirements.*\.txt$"), "requirements")
        .when(content.contains('"lockfileVersion"'), "npm")
        .when(content.contains("# yarn lockfile v1"), "yarn")
        .when(content.contains("lockfileVersion:"), "pnpm")
    )


def _npm(files: DataFrame) -> DataFrame:
    """v2 and v3 from the packages map but its root; v1 from dependencies and those below them, at any depth."""
    j = files.select("path", F.from_json("content", NPM).alias("j"))
    new = j.filter("j.packages is not null").select("path", F.posexplode("j.packages").alias("i", "key", "p")).filter("key <> ''")
    none = F.lit("0.0.0")
    new = new.select("path", F.array("i").alias("at"), F.regexp_extract("key", r"^(?:.*/)?node_modules/(.+)$", 1).alias("name"), F.coalesce("p.version", none).alias("version"), F.coalesce("p.dev", F.lit(False)).alias("dev"))
    # each level's dependencies stay JSON text until the level is read; the loop ends below the deepest one
    whole = files.join(j.filter("j.packages is null").select("path"), "path", "left_semi")
    # and is written, so no file is read twice
    level = checkpointed(whole.select("path", F.posexplode(F.from_json("content", "dependencies map<string,string>")["dependencies"]).alias("i", "name", "text")).withColumn("at", F.array("i")))
    while not level.isEmpty():
        own = level.select("path", "at", "name", F.from_json("text", "version string, dev boolean, dependencies map<string,string>").alias("d"))
        new = new.unionByName(own.select("path", "at", "name", F.coalesce("d.version", none).alias("version"), F.coalesce("d.dev", F.lit(False)).alias("dev")))
        level = checkpointed(own.select("path", "at", F.posexplode("d.dependencies").alias("i", "name", "text")).withColumn("at", F.concat("at", F.array("i"))))
    return new.filter("name <> ''")


def _yarn(files: DataFrame) -> DataFrame:
    """A header line names the package, the indented version line after it gives the version."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    header = F.when(F.col("line").rlike(r'^"?@?[^\s#"][^"]*@.*:\s*$'), F.regexp_extract("line", r'^"?(@?[^@"]+)@', 1))
    version = F.regexp_extract("line", r'^\s+version:?\s+"?([^"\s]+)"?', 1)
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("name", F.last(header, ignorenulls=True).over(w)).withColumn("version", version).filter("version <> '' and name is not null").select("path", F.array("at").alias("at"), "name", "version", F.lit(False).alias("dev"))


def _pnpm(files: DataFrame) -> DataFrame:
    pattern = F.lit(r"(?m)^\s+'?/?((?:@[^/\s'@]+/)?[^@\s'(/]+)@([^:\s'(]+)[^\n]*:")
    found = F.arrays_zip(F.regexp_extract_all("content", pattern, F.lit(1)).alias("name"), F.regexp_extract_all("content", pattern, F.lit(2)).alias("version"))
    return files.select("path", F.posexplode(found).alias("i", "x")).select("path", F.array("i").alias("at"), "x.name", "x.version", F.lit(False).alias("dev"))


def _requirements(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("i", "line")).withColumn("line", F.trim("line")).filter("line <> ''").filter(~F.col("line").rlike("^[#-]"))
    version = F.regexp_extract("line", r"^[A-Za-z0-9._\[\],-]+\s*(?:===|==|>=|<=|~=|!=|>|<)\s*([^\s,;#]+)", 1)
    return lines.select("path", F.array("i").alias("at"), S.pypi_name(F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("name"), F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown")).alias("version"), F.lit(False).alias("dev")).filter("name <> ''")


def lockfile_deps(files: DataFrame) -> DataFrame:
    """path, format, name, version, dev and is_native of every dependency, one row per name and file: the first in it."""
    known = files.withColumn("format", lockfile_format(F.col("path"), F.col("content")))
    out = None
    for name, parse in (("npm", _npm), ("yarn", _yarn), ("yarn-berry", _yarn), ("pnpm", _pnpm), ("requirements", _requirements)):
        part = parse(known.filter(F.col("format") == name)).withColumn("format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("path", "format", "name").agg(F.min_by(F.struct("version", "dev"), "at").alias("x")).select("path", "format", "name", "x.*")
    return one.withColumn("is_native", S.is_native_name(F.col("name")))


def ci_targets(files: DataFrame, native_only: bool = False, include_dev: bool = False) -> DataFrame:
    out = lockfile_deps(files).filter("format = 'npm'")
    if not include_dev:
        out = out.filter("not dev")
    return out.filter("is_native") if native_only else out


def wheel_headers(files: DataFrame) -> DataFrame:
    """path, key and values of the headers of WHEEL and METADATA files; what follows a blank line is left out."""
    lines = files.select("path", F.posexplode(F.split(F.get(F.split("content", r"\r?\n\r?\n"), F.lit(0)), r"\r?\n")).alias("at", "line")).filter(F.col("line").contains(":"))
    key, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    pairs = lines.select("path", key.alias("key"), F.struct("at", value.alias("value")).alias("v"))
    return pairs.groupBy("path", "key").agg(F.transform(F.array_sort(F.collect_list("v")), lambda x: x["value"]).alias("values"))  # headers of one file


def header_values(content: Column, key: str) -> Column:
    """The values of a header in the order of its lines, without what follows a blank line."""
    head = F.get(F.split(content, r"\r?\n\r?\n"), F.lit(0))
    return F.regexp_extract_all(head, F.lit(rf"(?im)^{key}:[ \t]*([^\r\n]*?)[ \t]*$"), F.lit(1))


def wheel_metadata(files: DataFrame) -> DataFrame:
    """One row per wheel (its .dist-info folder): name, version, tags, generator and requirements."""
    own = files.filter(F.col("path").rlike(r"\.dist-info/(WHEEL|METADATA)$")).withColumn("wheel", F.regexp_extract("path", r"([^/]+)\.dist-info/", 1))
    many = lambda k: F.coalesce(F.max(F.when(F.size(header_values(F.col("content"), k)) > 0, header_values(F.col("content"), k))), F.array().cast("array<string>"))
    one = lambda k: F.get(many(k), F.lit(0))
    return own.groupBy("wheel").agg(one("Name").alias("name"), one("Version").alias("version"), one("Generator").alias("generator"), many("Tag").alias("tags"), (F.lower(one("Root-Is-Purelib")) == "true").alias("pure"), F.transform(many("Requires-Dist"), S.required_name).alias("requires"))


def record_entries(files: DataFrame) -> DataFrame:
    """wheel, file and SHA-256 (hexadecimal; null if not given) of each line of RECORD files."""
    r = files.filter(F.col("path").rlike(r"\.dist-info/RECORD$")).select(F.regexp_extract("path", r"([^/]+)\.dist-info/", 1).alias("wheel"), F.explode(F.split("content", r"\r?\n")).alias("line")).filter("line <> ''")
    digest = F.regexp_extract("line", r",sha256=([A-Za-z0-9_-]+)", 1)
    plain = F.translate(digest, "_-", "/+")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return r.select("wheel", F.regexp_extract("line", r"^([^,]+),", 1).alias("file"), F.when(digest != "", F.lower(F.hex(F.unbase64(padded)))).alias("sha256"))


def verify_records(records: DataFrame, contents: DataFrame) -> DataFrame:
    """records with `verified` against contents (wheel, file, content): null without a digest or for RECORD itself, false if missing."""
    actual = contents.select("wheel", "file", F.sha2("content", 256).alias("actual"))
    skip = F.col("sha256").isNull() | F.col("file").rlike(r"(?:^|/)(RECORD|WHEEL\.sig)$")
    return records.join(actual, ["wheel", "file"], "left").withColumn("verified", F.when(skip, None).otherwise(F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False)))).drop("actual")


#: First bytes of binary formats as hexadecimal digits, formats by extension, and numbers in their headers.
MAGIC = {"elf": "7F454C46", "pe": "4D5A", "macho": "(?:FEEDFACE|FEEDFACF|CEFAEDFE|CFFAEDFE|CAFEBABE)", "wasm": "0061736D", "gzip": "1F8B", "zip": "504B0304"}
EXTENSIONS = {"elf": r"\.(?:node|so)$", "pe": r"\.dll$", "macho": r"\.dylib$", "wasm": r"\.wasm$"}
ELF_MACHINES = {3: "x86", 8: "mips", 20: "ppc", 21: "ppc64", 22: "s390x", 40: "arm", 62: "x86_64", 183: "arm64", 243: "riscv"}
ELF_TYPES = {1: "relocatable", 2: "executable", 3: "shared-library", 4: "core"}
PE_MACHINES = {0x14C: "x86", 0x8664: "x86_64", 0x1C0: "arm", 0x1C4: "arm", 0xAA64: "arm64"}
PE_DLL = 0x2000
MACHO_MACHINES = {7: "x86", 0x1000007: "x86_64", 12: "arm", 0x100000C: "arm64", 18: "ppc", 0x1000012: "ppc64"}
MACHO_TYPES = {1: "relocatable", 2: "executable", 6: "shared-library", 8: "shared-library"}
INTERESTING = r"(?i)https?://|\.(?:com|net|org|io)\b|/etc/|/tmp/|cmd\.exe|/bin/(?:ba)?sh|token|secret|password"


def number_at(data: Column, at: Column | int, size: int, little: Column | bool) -> Column:
    """An unsigned number of `size` bytes at a place of a binary column, in either byte order; null behind its end."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = [F.substring(data, F.least(at + i + 1, F.lit(2**31 - 1)).cast("int"), F.lit(1)) for i in range(size)]
    big, small = F.concat(*[F.hex(b) for b in byte]), F.concat(*[F.hex(b) for b in reversed(byte)])
    digits = F.when(F.lit(little) if isinstance(little, bool) else little, small).otherwise(big)
    return F.when(F.length(data) >= at + size, F.conv(digits, 16, 10).cast("long"))


def _named(number: Column, names: dict[int, str]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))]), number)


def header_fields(data: Column, kind: Column) -> Column:
    """struct<machine, file_type, little, bits> from an executable's header; fields that can't be read are null."""
    first = F.hex(F.substring(data, 1, 4))
    elf = number_at(data, 5, 1, True) == 1
    mac = first.isin("CEFAEDFE", "CFFAEDFE")
    pe = number_at(data, 60, 4, True)
    signed = F.hex(F.substring(data, F.least(pe + 1, F.lit(2**31 - 1)).cast("int"), F.lit(4))) == "50450000"
    dll = F.when(signed, F.when(number_at(data, pe + 22, 2, True).bitwiseAND(PE_DLL) > 0, "shared-library").otherwise("executable"))
    thin = (kind == "macho") & (first != "CAFEBABE")
    machine = F.when(kind == "elf", _named(number_at(data, 18, 2, elf), ELF_MACHINES)).when((kind == "pe") & signed, _named(number_at(data, pe + 4, 2, True), PE_MACHINES)).when(thin, _named(number_at(data, 4, 4, mac), MACHO_MACHINES))
    file_type = F.when(kind == "elf", _named(number_at(data, 16, 2, elf), ELF_TYPES)).when(kind == "pe", F.when(number_at(data, pe + 22, 2, True).isNotNull(), dll)).when(thin, _named(number_at(data, 12, 4, mac), MACHO_TYPES))
    bits = F.when(kind == "elf", F.when(number_at(data, 4, 1, True) == 2, 64).when(number_at(data, 4, 1, True) == 1, 32)).when(thin, F.when(first.isin("FEEDFACF", "CFFAEDFE"), 64).otherwise(32))
    return F.struct(machine.alias("machine"), file_type.alias("file_type"), F.when(kind == "elf", elf).when(kind == "pe", True).when(thin, mac).alias("little"), bits.alias("bits"))


def fingerprint(files: DataFrame) -> DataFrame:
    """path, sha256, size, format, printable and interesting strings, architecture, kind and header fields of binary files (path, content).

    The format goes by the first bytes, else by the extension.  architecture and kind are guessed from the path and the
    strings; machine, file_type, little and bits are read from the header.
    """
    head, kind = F.hex(F.substring("content", 1, 4)), None
    for name, magic in MAGIC.items():
        hit = head.rlike(f"^{magic}")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    for name, ending in EXTENSIONS.items():
        kind = kind.when(F.lower("path").rlike(ending), name)
    strings = F.array_distinct(F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"[\x20-\x7E]{4,}"), F.lit(0)))
    x = files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), kind.otherwise("unknown").alias("format"), strings.alias("strings"))
    x = x.withColumn("interesting", F.filter("strings", lambda s: s.rlike(INTERESTING)))
    told = lambda p: F.lower("path").rlike(p) | F.exists("strings", lambda s: F.lower(s).rlike(p))
    architecture = F.when(F.col("format") == "wasm", "wasm32").when(told("arm64|aarch64"), "arm64").when(told("x64|amd64|x86_64"), "x86_64").when(told("ia32|x86"), "x86").otherwise("unknown")
    what = F.when(F.col("format") == "wasm", "wasm").when(told("node|napi|addon"), "native-addon").when(F.col("format").isin("elf", "pe", "macho"), "shared-library").when(F.size("strings") > 0, "binary").otherwise("unknown")
    x = x.withColumn("architecture", architecture).withColumn("kind", what).withColumn("h", header_fields(F.col("content"), F.col("format")))
    return x.select("path", "sha256", "size", "format", "strings", "interesting", "architecture", "kind", "h.*")
