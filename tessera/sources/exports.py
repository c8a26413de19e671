"""Readers of tool exports: CSV tables, assembly and pseudocode files, of two tools' views.

View 1 exports need ``offset`` taken off their addresses; view 2 gives the reference addresses.

A tool writes a file for each function or target.  Listing and opening millions of small files takes longer than reading them, so
large exports are ``packed``: Parquet of whole files (``file, value``), as many files as Spark has tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.schema import conform

_ADDRESS_LINE = r"^\s*(0x[0-9A-Fa-f]+|[0-9A-Fa-f]+)\s+(.*)$"


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file or folder with a header, every column a string; missing ones are null."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    have = set(df.columns)
    return df.select([(F.col(f"`{c}`") if c in have else F.lit(None).cast("string")).alias(c) for c in columns])


def _address(name: str, offset: int) -> Column:
    return T.parse_hex(F.col(f"`{name}`")) - F.lit(offset).cast("bigint")


def read_segments(spark: SparkSession, path: str, view_id: int, offset: int = 0) -> DataFrame:
    """Segments of either tool: separate Read/Write/Execute flags or one hexadecimal mask ``Perm``."""
    rows = read_csv(spark, path, ["Name", "Start Address", "End Address", "Length", "Read", "Write", "Execute", "Perm"])
    mask = T.parse_hex(F.col("Perm")).cast("int")

    def right(flag: str, bit: int) -> Column:
        return F.coalesce(T.flag(F.col(flag)), F.when(mask.isNotNull(), F.when(mask.bitwiseAND(bit) != 0, 1).otherwise(0)))

    out = rows.select(
        F.lit(view_id).alias("view_id"), F.col("Name").alias("name"), _address("Start Address", offset).alias("start_va"), _address("End Address", offset).alias("end_va"),
        F.coalesce(F.col("Length").try_cast("bigint"), T.parse_hex(F.col("Length"))).alias("length"), right("Read", 4).alias("perm_r"), right("Write", 2).alias("perm_w"), right("Execute", 1).alias("perm_x"), F.col("Perm").alias("raw_perm"))
    return conform(out.where("start_va is not null and end_va is not null"), "segments")


def image_base(segments: DataFrame) -> DataFrame:
    """``view_id, image_base``: the start of the headers segment, else the least start."""
    return segments.groupBy("view_id").agg(F.coalesce(F.max(F.when(F.lower("name") == "headers", F.col("start_va"))), F.min("start_va")).alias("image_base"))


def read_sections(spark: SparkSession, path: str, view_id: int, offset: int = 0) -> DataFrame:
    rows = read_csv(spark, path, ["Name", "Start Address", "End Address", "Length"])
    out = rows.select(F.lit(view_id).alias("view_id"), F.col("Name").alias("name"), _address("Start Address", offset).alias("start_va"), _address("End Address", offset).alias("end_va"), F.coalesce(F.col("Length").try_cast("bigint"), T.parse_hex(F.col("Length"))).alias("length"))
    return conform(out.where("start_va is not null and end_va is not null"), "sections")


def normal_symbols(rows: DataFrame, view_id: int, offset: int = 0) -> DataFrame:
    """Symbols from raw columns Name, Address, Type, Source, Is Global, Is Primary, Is External, Namespace."""
    external = T.flag(F.col("`Is External`"))
    out = rows.select(
        F.lit(view_id).alias("view_id"), F.trim("Name").alias("name"), _address("Address", offset).alias("address_va"), F.col("Address").alias("raw_address"), T.symbol_kind(F.col("Type"), external).alias("kind"), F.col("Type").alias("raw_type"),
        F.col("Source").alias("source"), T.flag(F.col("`Is Global`")).alias("is_global"), T.flag(F.col("`Is Primary`")).alias("is_primary"), external.alias("is_external"), F.col("Namespace").alias("namespace"))
    return conform(out, "symbols")


def read_symbols(spark: SparkSession, path: str, view_id: int, offset: int = 0) -> DataFrame:
    return normal_symbols(read_csv(spark, path, ["Name", "Address", "Type", "Source", "Is Global", "Is Primary", "Is External", "Namespace"]), view_id, offset)


def read_strings(spark: SparkSession, path: str, view_id: int) -> DataFrame:
    rows = read_csv(spark, path, ["String", "Address", "Length"])
    out = rows.select(F.lit(view_id).alias("view_id"), F.col("String").alias("value"), _address("Address", 0).alias("address_va"), F.col("Length").try_cast("bigint").alias("length"))
    return conform(out.where("address_va is not null"), "strings")


def xref_target(stem: Column, strict: bool = False) -> tuple[Column, Column]:
    """Target address and name from a file's stem ``base_addr_name_refs``.  Names with underscores
    shift the address by default, as the export's own convention does; ``strict`` reads them whole."""
    parts = F.split(stem, "_")
    if strict:
        address = F.regexp_extract(stem, r"(?:^|_)(?:0x)?([0-9A-Fa-f]{4,16})_.+_refs$", 1)
        return T.parse_hex(address), F.regexp_extract(stem, r"(?:^|_)(?:0x)?[0-9A-Fa-f]{4,16}_(.+)_refs$", 1)
    enough = F.size(parts) >= 4
    return F.when(enough, T.parse_hex(F.element_at(parts, -3))), F.when(enough, F.element_at(parts, -2))


def file_name(path: Column) -> Column:
    """Name of an export file: the last part of its path or, where Spark wrote a file's rows under its name
    (``file=<name>/part-...``), that name."""
    named = F.regexp_extract(path, r"/file=([^/]+)/[^/]+$", 1)
    return F.when(named != "", named).otherwise(F.element_at(F.split(path, "/"), -1))


def read_xrefs(spark: SparkSession, folder: str, view_id: int, offset: int = 0, strict: bool = False) -> DataFrame:
    """Cross-references: targets come from file names, sources from rows.  Rows packed into common files name their own
    file in a column ``Export File``."""
    rows = spark.read.option("header", True).csv(folder, recursiveFileLookup=True)
    have = set(rows.columns)
    column = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    rows = rows.select(column("Reference From Address").alias("src"), column("Reference Type").alias("type"), column("Containing Function").alias("inside"), column("Primary Ref").alias("primary"), F.coalesce(column("Export File"), file_name(F.col("_metadata.file_path"))).alias("file"))
    address, name = xref_target(F.regexp_replace("file", r"\.csv$", ""), strict)
    out = rows.select(
        F.lit(view_id).alias("view_id"), (T.parse_hex(F.col("src")) - offset).alias("src_va"), (address - offset).alias("dst_va"), name.alias("dst_name"), F.col("type").alias("ref_type_raw"),
        F.col("inside").alias("containing_function"), T.flag(F.col("primary")).alias("is_primary"), F.col("file").alias("raw_file"))
    return conform(out.where("src_va is not null"), "xrefs")


def _files(spark: SparkSession, folder: str, suffix: str, packed: bool = False) -> DataFrame:
    """``file, stem, lines`` of a folder's whole files with that suffix."""
    if packed:
        rows = spark.read.schema("file string, value string").parquet(folder)
    else:
        found = spark.read.option("pathGlobFilter", f"{{*{suffix},part-*}}").option("recursiveFileLookup", True).text(folder, wholetext=True)
        rows = found.select(file_name(F.col("_metadata.file_path")).alias("file"), "value")
    rows = rows.where(F.col("file").endswith(suffix))
    return rows.select("file", F.regexp_replace("file", rf"\{suffix}$", "").alias("stem"), F.split("value", r"\r\n|\r|\n").alias("lines"))


def _header(lines: Column, most: int = 6) -> tuple[Column, Column]:
    """Entry address and function name from a file's first lines."""
    head = F.slice(lines, 1, most)
    addresses = F.transform(head, lambda s: T.parse_hex(F.regexp_extract(s, r"(?:Start EA:|Address:)\s*(\S+)", 1)))
    names = F.transform(head, lambda s: F.trim(F.regexp_extract(s, r"^\s*(?:;|//) Function:(.*)$", 1)))
    return F.get(F.filter(addresses, lambda a: a.isNotNull()), F.lit(0)), F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def _identified(files: DataFrame, offset: int) -> DataFrame:
    address, name = _header(F.col("lines"))
    stem_va = T.parse_hex(F.regexp_extract("stem", r"^(?:0x)?([0-9A-Fa-f]+)_", 1))
    stem_name = F.nullif(F.regexp_extract("stem", r"^(?:0x)?[0-9A-Fa-f]+_(.+)", 1), F.lit(""))
    out = files.withColumn("entry_va", F.coalesce(address, stem_va) - offset).withColumn("name", F.coalesce(name, stem_name, F.col("stem")))
    return out.where("entry_va is not null")


def read_assembly(spark: SparkSession, folder: str, view_id: int, offset: int = 0, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Functions and their instructions, one file a function.  Identifiers are hashes of view and
    entry address, the same in every run."""
    files = _identified(_files(spark, folder, ".asm", packed), offset)
    key = F.xxhash64(F.lit(view_id), F.col("entry_va"))
    functions = files.groupBy("entry_va").agg(F.min_by(F.struct("name", "file"), F.col("file")).alias("f"))
    functions = functions.select(key.alias("id"), F.lit(view_id).alias("view_id"), "entry_va", F.col("f.name").alias("name"), F.col("f.file").alias("raw_file"))
    lines = files.select("entry_va", "file", F.posexplode("lines").alias("line_no", "raw_line"))
    body = F.regexp_extract("raw_line", _ADDRESS_LINE, 2)
    code, comment = F.trim(F.regexp_extract(body, r"^([^;]*)", 1)), F.regexp_extract(body, r"^[^;]*;(.*)$", 1)
    rows = lines.select("entry_va", "file", "line_no", "raw_line", (T.parse_hex(F.regexp_extract("raw_line", _ADDRESS_LINE, 1)) - offset).alias("address_va"), code.alias("code"), comment.alias("comment")).where((F.col("address_va").isNotNull()) & (F.col("code") != "") & ~F.trim("raw_line").startswith(";"))
    index = F.row_number().over(W.partitionBy("entry_va", "file").orderBy("line_no")) - 1
    instructions = rows.select(
        F.lit(view_id).alias("view_id"), key.alias("function_id"), index.alias("index_in_function"), "address_va", F.nullif(F.regexp_extract("comment", r"([0-9A-Fa-f]{2}(?:\s+[0-9A-Fa-f]{2})*)", 1), F.lit("")).alias("bytes"),
        F.regexp_extract("code", r"^(\S+)", 1).alias("mnemonic"), F.nullif(F.trim(F.regexp_extract("code", r"^\S+(.*)$", 1)), F.lit("")).alias("op_str"), "raw_line")
    return conform(functions, "functions"), conform(instructions, "instructions")


def read_pseudocode(spark: SparkSession, folder: str, view_id: int, offset: int = 0, packed: bool = False) -> DataFrame:
    """Pseudocode: the first line that is neither blank nor a comment is the prototype, the rest the body."""
    files = _identified(_files(spark, folder, ".c", packed), offset)
    code = lambda s: (F.trim(s) != "") & ~F.trim(s).startswith("//")
    first = F.array_position(F.transform("lines", code), True)
    out = files.select(
        F.lit(view_id).alias("view_id"), F.xxhash64(F.lit(view_id), F.col("entry_va")).alias("function_id"), "entry_va", "name", F.when(first > 0, F.trim(F.get("lines", first - 1))).alias("prototype"),
        F.when(first > 0, F.regexp_replace(F.array_join(F.slice("lines", first + 1, F.greatest(F.lit(1), F.size("lines"))), "\n"), r"^\s+|\s+$", "")).otherwise("").alias("body"), F.col("file").alias("raw_file"))
    return conform(out, "pseudo_functions")


def load_view(spark: SparkSession, root: str, base: str, view_id: int, offset: int = 0, with_strings: bool = True, packed: bool = False) -> dict[str, DataFrame]:
    """All tables of one view exported under ``root`` with files named after ``base``, code and listings ``packed`` or not."""
    functions, instructions = read_assembly(spark, f"{root}/disassembly", view_id, offset, packed)
    out = {
        "segments": read_segments(spark, f"{root}/{base}_segments.csv", view_id, offset),
        "sections": read_sections(spark, f"{root}/{base}_sections.csv", view_id, offset),
        "symbols": read_symbols(spark, f"{root}/{base}_symbols.csv", view_id, offset),
        "functions": functions, "instructions": instructions,
        "xrefs": read_xrefs(spark, f"{root}/xrefs", view_id, offset),
        "pseudo_functions": read_pseudocode(spark, f"{root}/pseudocode", view_id, offset, packed),
    }
    if with_strings:
        out["strings"] = read_strings(spark, f"{root}/{base}_strings.csv", view_id)
    return out


def file_hashes(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``path, hash_md5, hash_sha256`` of binary files; of packed ones the path is the file's name."""
    if packed:
        found = spark.read.schema("file string, value binary").parquet(path).select(F.col("file").alias("path"), F.col("value").alias("content"))
        return found.select("path", F.md5("content").alias("hash_md5"), F.sha2("content", 256).alias("hash_sha256"))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("hash_md5"), F.sha2("content", 256).alias("hash_sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark sample of the JSON manifests at ``path``, defaults filled in."""
    ddl = (
        "defaults struct<timeout_seconds int, engines array<string>, common_args array<string>>, "
        "samples array<struct<name string, input string, db string, binary_id bigint, goal_keywords array<string>, expectations struct<goal_vas array<string>, path_subsequences array<array<string>>, profile_tokens map<string, array<string>>>>>")
    rows = spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select("defaults", F.explode("samples").alias("s")).select("s.*", F.coalesce("defaults.timeout_seconds", F.lit(1800)).alias("timeout_seconds"), F.coalesce("defaults.engines", F.array(F.lit("practical"))).alias("engines"))
