"""Rules that a table of questions, its records and two views of it must keep; what breaks them is a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import holds
from tessera.operators.joins import join_problems

#: A SHA-256 as text, and the ages that a record may tell.
SHA256 = "^[0-9a-f]{64}$"
AGES = (0, 120)


@dataclass(frozen=True)
class TableRules:
    """What a table of files says: its splits, the endings of its files and pictures, whether equal contents are an error, and its optional columns.

    pictures: a column array<struct<path: string, sha256: string>>.
    """

    splits: tuple[str, ...] = ("train", "val", "test")
    endings: tuple[str, ...] = ("jpg", "jpeg", "png")
    picture_endings: tuple[str, ...] = ("jpg", "jpeg", "png")
    unique_content: bool = True
    facts: str | None = None
    pictures: str | None = None


def _ends(path: Column, endings: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./](\.[^./]+)$", 1)).isin(*[f".{e}" for e in endings])


def _plain_parts(path: Column) -> Column:
    return ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def table_problems(rows: DataFrame, rules: TableRules = TableRules(), line: str = "line") -> DataFrame:  # noqa: B008
    """rows (line, split, label, path, sha256 and the columns that `rules` names) -> (line, problem): every rule that every row breaks.

    A path is split/label/file; paths, contents and pictures stand once, and a row that repeats one tells the first line
    of it. Nulls break the rules of their columns, but repeat nothing. Lines must tell rows apart.
    """
    no = lambda test: ~F.coalesce(test, F.lit(False))
    path, pictures = F.col("path"), F.col(rules.pictures) if rules.pictures else F.lit(None)
    parts = F.split(path, "/")
    tests = {
        "the split is not known": no(F.col("split").isin(*rules.splits)),
        "the path is not split/label/file": no((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == F.col("split")) & (F.get(parts, F.lit(1)) == F.col("label")) & _plain_parts(path)),
        "the file has another ending": no(_ends(path, rules.endings)),
        "the sha256 is not 64 hexadecimal characters": no(F.rlike("sha256", F.lit(SHA256))),
    }
    if rules.facts:
        tests["the facts are empty"] = no(F.btrim(rules.facts) != "")
    if rules.pictures:
        tests["no picture is listed"] = no(F.size(pictures) > 0)
        tests["a picture is not a picture file inside the folder"] = F.coalesce(F.exists(pictures, lambda p: no(_ends(p["path"], rules.picture_endings) & _plain_parts(p["path"]))), F.lit(False))
        tests["the sha256 of a picture is not 64 hexadecimal characters"] = F.coalesce(F.exists(pictures, lambda p: no(F.rlike(p["sha256"], F.lit(SHA256)))), F.lit(False))
    broken = rows.select(F.col(line).alias("line"), F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))).alias("problem"))
    one = lambda what, value: rows.select(F.col(line).alias("line"), F.lit(what).alias("what"), value.alias("value"))
    keys = [one("path", path)] + ([one("content", F.col("sha256"))] if rules.unique_content else [])
    if rules.pictures:
        keys += [_each(rows, line, rules.pictures, c) for c in ("path", "sha256")]
    told = reduce(DataFrame.unionByName, keys).where("value IS NOT NULL")
    first = told.groupBy("what", "value").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = told.join(first, ["what", "value"]).where("line > first").select("line", F.concat(F.lit("the same "), "what", F.lit(" is also on line "), F.col("first").cast("string")).alias("problem"))
    return broken.unionByName(again)


def _each(rows: DataFrame, line: str, pictures: str, column: str) -> DataFrame:
    return rows.select(F.col(line).alias("line"), F.lit("picture").alias("what"), F.explode(F.transform(F.col(pictures), lambda p: p[column])).alias("value"))


@dataclass(frozen=True)
class Field:
    """A line of a record: its name, the column, and the kind of its values: `age`, `site` or `yes_no`; only the last may be a gap."""

    name: str
    column: str
    kind: str


def _printed(f: Field, not_recorded: str) -> tuple[Column, Column]:
    """(the value as it is printed, whether it can be)."""
    v = F.col(f.column)
    if f.kind == "age":
        n = F.when(F.rlike(v, F.lit("^[0-9]{1,9}$")), v.try_cast("int"))
        return n.cast("string"), F.coalesce(n.between(*AGES), F.lit(False))
    if f.kind == "site":
        return F.lower(v), F.coalesce(v != not_recorded, F.lit(False))
    if f.kind == "yes_no":
        said = F.when(v == not_recorded, "unknown").when(v == "TRUE", "yes").when(v == "FALSE", "no")
        return said, said.isNotNull()
    raise ValueError(f"no such kind of field: {f.kind}")


def record_problems(rows: DataFrame, key: str, fields: list[Field], not_recorded: str = "not recorded") -> DataFrame:
    """(key, problem): the values that a record can't print: an age that is no whole number from 0 to 120, a flag that is neither, a gap where none may be."""
    told = [F.when(~fine, F.concat(F.lit(f"{f.column} can't be printed: "), F.coalesce(f.column, F.lit("null")))) for f in fields for _, fine in [_printed(f, not_recorded)]]
    return rows.select(key, F.explode(F.array_compact(F.array(*told))).alias("problem"))


def with_record(rows: DataFrame, key: str, fields: list[Field], out: str = "record", not_recorded: str = "not recorded") -> DataFrame:
    """Add the record of a row, numbered lines `1. name: value`; a value that can't be printed (see record_problems()) stops the step, whatever is read."""
    printed = [_printed(f, not_recorded) for f in fields]
    every = reduce(Column.__and__, [fine for _, fine in printed])
    sure = rows.where(holds(every, F.concat(F.lit("a record can't be printed: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return sure.withColumn(out, F.concat_ws("\n", *[F.concat(F.lit(f"{i}. {f.name}: "), text) for i, (f, (text, _)) in enumerate(zip(fields, printed, strict=True), 1)]))


def view_problems(a: DataFrame, b: DataFrame, question: str, group: str, label: str, subset: bool = False) -> DataFrame:
    """(question, problem): why two views of questions are not aligned: other questions (with `subset`, some that only the first has), one twice, another group; and classes that only one view has, told by their name."""
    named = lambda df: df.select(question, F.col(group).alias("group"))
    found = join_problems(named(a), named(b), [question], ["group"], subset)
    classes = lambda df: df.select(F.col(label).cast("string").alias("label")).distinct()
    other = join_problems(classes(a), classes(b), ["label"])
    return found.select(F.col(question).cast("string").alias("item"), "problem").unionByName(other.select(F.col("label").alias("item"), F.concat(F.lit("the answer option is "), "problem").alias("problem")))
