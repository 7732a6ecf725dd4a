"""Schemas that drift between files of JSON records: what changed in which file, and one consistent table of all records.

The fields (leaf paths) of each file are read in parallel, in Arrow batches, and folded by Spark aggregates over a lattice: a
field's types in a file are the union of its records' types. Each file is held against its writer's file with the next lower
number that is there, by one shuffle on (file, field).

A field that goes and one that comes in the same file, with the same types, are one renamed field if the new one carries on the
content of the old one: shared tokens and shapes of texts, shared ranges of numbers, and if no file of any writer has both names
side by side, as fields that differ do. Among several candidates in a file the best pair wins, then the best of those left.

Types promote along null < boolean < string, null < long < decimal < string, null < long < double < string, null < array < string, so
that a consistent table has one type per field, which holds all its values: whole numbers stay whole (decimal from 64 bits, text
from 39 digits), and fractions become text only beside whole numbers that a double can't hold. Names that were renamed are
resolved to the name that most files use.

Defined results: rows whose raw text is not a JSON object (torn, blank, null) are left out, and a file without any other rows is
not there. Objects are entered, arrays are not; a field that is null throughout is not in the file. Repeated rows change nothing.
Of repeated keys in an object the last one counts. Empty tables give no changes.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = ["src_table", "writer_id", "file_no"]
#: Content of a removed and an added field is alike from here; a pair that is alike in some file needs no more than a hint in another.
ALIKE, HINT = 0.5, 0.2

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_RUN = re.compile(r"\d+|[^\W\d_]+")


def leaves(o: dict, path: str | None = None) -> Iterator[tuple[str, object]]:
    """(path, value) of all leaves, without recursion so that depth doesn't matter."""
    stack = [(path, o)]
    while stack:
        p, d = stack.pop()
        for k, v in d.items():
            q = k if p is None else f"{p}.{k}"
            if isinstance(v, dict):
                stack.append((q, v))
            else:
                yield q, v


def clean(s: str) -> str:
    """Text that UTF-8 can hold: lone surrogates, which JSON escapes may spell, become question marks."""
    try:
        s.encode()
    except UnicodeEncodeError:
        return s.encode("utf-8", "replace").decode()
    return s


def kind_of(v: object) -> str | None:
    if v is None:
        return None
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array"


def number_kind(v: int | float) -> str:
    """The place of a number in the lattice: int53 (a double holds it), int64, int38 (digits), big or float."""
    if isinstance(v, float):
        return "float"
    a = abs(v)
    return "int53" if a <= 1 << 53 else "int64" if -(1 << 63) <= v < 1 << 63 else "int38" if a < 10**38 else "big"


def _strict(x: str) -> float:
    raise ValueError(x)


def parse(raw: str | None) -> dict | None:
    """A JSON object, or None for anything else."""
    if not raw or not raw.lstrip()[:1] == "{":
        return None
    try:
        o = json.loads(raw, parse_constant=_strict)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def content(v: object) -> tuple[set[str], float | None]:
    """Tokens and shape of a value, or its size on a logarithmic scale for numbers."""
    if isinstance(v, bool):
        return {str(v)}, None
    if isinstance(v, (int, float)):
        size = math.log10(1 + min(abs(v), 1e300))
        return ({"#int"} if isinstance(v, int) or v.is_integer() else {"#frac"}), size if v >= 0 else -size
    s = clean(v) if isinstance(v, str) else json.dumps(v, sort_keys=True)
    words = {t.lower() if not t.isdigit() else "9" for t in _TOKEN.findall(s)}
    shape = _RUN.sub(lambda m: "9" if m.group()[0].isdigit() else "a", s)
    # a form is short; whatever is longer is free text, of which the words tell more than the signs
    return words | {f"~{shape}" if len(shape) <= 40 else "~long"}, None


def file_fields(df: DataFrame, src_table: str) -> DataFrame:
    """One row per (file, field): types (sorted), tokens, numbers (see ``number_kind``), lo, hi, n; and per file one with a null path, which says that the file is there."""
    src = df.select(F.col("writer_id").cast("string").alias("writer_id"), F.col("file_no").cast("bigint").alias("file_no"), F.col("raw").cast("string").alias("raw"))
    schema = "writer_id string, file_no bigint, path string, types array<string>, tokens array<string>, numbers array<string>, lo double, hi double, n bigint"
    out_type = pa.schema([("writer_id", pa.string()), ("file_no", pa.int64()), ("path", pa.string()), ("types", pa.list_(pa.string())), ("tokens", pa.list_(pa.string())), ("numbers", pa.list_(pa.string())), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            acc: dict[tuple, list] = {}
            for w, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                o = parse(raw)
                if o is None:
                    continue
                acc.setdefault((w, n, None), [set(), set(), None, None, 0, set()])
                for p, v in dict(leaves(o)).items():
                    k = kind_of(v)
                    if k is None:
                        continue
                    a = acc.setdefault((w, n, clean(p)), [set(), set(), None, None, 0, set()])
                    tok, x = content(v)
                    a[0].add(k)
                    a[1] |= tok
                    if x is not None:
                        a[2], a[3] = (x, x) if a[2] is None else (min(a[2], x), max(a[3], x))
                        a[5].add(number_kind(v))
                    a[4] += 1
            rows = [{"writer_id": w, "file_no": n, "path": p, "types": list(a[0]), "tokens": list(a[1]), "numbers": list(a[5]), "lo": a[2], "hi": a[3], "n": a[4]} for (w, n, p), a in acc.items()]
            yield from pa.Table.from_pylist(rows, schema=out_type).to_batches()

    each = src.mapInArrow(run, schema)
    return (
        each.groupBy("writer_id", "file_no", "path")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
            F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("n").alias("n"),
        )
        .select(F.lit(src_table).alias("src_table"), "writer_id", "file_no", "path", F.concat_ws("|", "types").alias("types"), "tokens", "numbers", "lo", "hi", "n")
    )


def neighbours(files: DataFrame, block: int = 4096) -> DataFrame:
    """Each file with the next lower and next higher number of its writer that are there.

    Windows run over blocks of file numbers, then over the blocks' ends, so that one writer's files are never in one task.
    """
    f = files.select(*FILE).distinct().withColumn("_b", F.floor(F.col("file_no") / block))
    w = Window.partitionBy("src_table", "writer_id", "_b").orderBy("file_no")
    f = f.withColumn("prev_no", F.lag("file_no").over(w)).withColumn("next_no", F.lead("file_no").over(w))
    ends = f.groupBy("src_table", "writer_id", "_b").agg(F.min("file_no").alias("_lo"), F.max("file_no").alias("_hi"))
    v = Window.partitionBy("src_table", "writer_id").orderBy("_b")
    ends = ends.select("src_table", "writer_id", "_b", F.lag("_hi").over(v).alias("_before"), F.lead("_lo").over(v).alias("_after"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("src_table", "writer_id", "_b")]
    return f.alias("f").join(ends.alias("e"), same, "left").select("f.src_table", "f.writer_id", "f.file_no", F.coalesce("prev_no", "_before").alias("prev_no"), F.coalesce("next_no", "_after").alias("next_no"))


def _differences(fields: DataFrame, chain: DataFrame) -> DataFrame:
    """(file, path) with what the field was in the file before and is now: old, new (structs or null); only where types differ."""
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"c.{c}")) for c in FILE]
    x = fields.where("path IS NOT NULL").alias("x").join(chain.alias("c"), on)
    what = F.struct("x.types", "x.tokens", "x.lo", "x.hi", "x.n")
    now = x.where("c.prev_no IS NOT NULL").select("x.src_table", "x.writer_id", "x.file_no", "x.path", F.lit(None).cast(x.select(what.alias("w")).schema["w"].dataType).alias("old"), what.alias("new"))
    was = x.where("c.next_no IS NOT NULL").select("x.src_table", "x.writer_id", F.col("c.next_no").alias("file_no"), "x.path", what.alias("old"), F.lit(None).cast(now.schema["new"].dataType).alias("new"))
    both = now.unionByName(was).groupBy(*FILE, "path").agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"))
    return both.where("old IS NULL OR new IS NULL OR old.types <> new.types")


def differences(fields: DataFrame) -> DataFrame:
    """Every field that came, went or changed its types, before any two are taken for one renamed field: the columns of ``changes``."""
    d = _differences(fields, neighbours(fields))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("retyped")
    return d.select(*FILE, kind.alias("change_kind"), F.col("path").alias("field_path"), F.coalesce("old.types", F.lit("")).alias("old_value"), F.coalesce("new.types", F.lit("")).alias("new_value"))


def _score(o: str, n: str) -> tuple:
    """(content, name) likeness of two fields ``o`` and ``n``, each from 0 to 1."""
    ot, nt = F.col(f"{o}.tokens"), F.col(f"{n}.tokens")
    word = lambda t: F.filter(t, lambda x: ~x.startswith("~"))
    shape = lambda t: F.filter(t, lambda x: x.startswith("~"))
    part = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))
    text = 0.7 * part(word(ot), word(nt)) + 0.3 * part(shape(ot), shape(nt))
    # empty texts and arrays say nothing either way
    text = F.when((F.size(word(ot)) == 0) | (F.size(word(nt)) == 0), F.lit(0.7) * 1 + 0.3 * part(shape(ot), shape(nt))).otherwise(text)
    gap = F.greatest(F.col(f"{o}.lo"), F.col(f"{n}.lo")) - F.least(F.col(f"{o}.hi"), F.col(f"{n}.hi"))
    frac = lambda t: F.array_contains(t, "#frac")
    number = F.when(gap <= 0.3, F.lit(0.8)).when(gap <= 0.7, 0.55).otherwise(0.1) + F.when(frac(ot) == frac(nt), 0.2).otherwise(0.0)
    both_num = (F.col(f"{o}.types") == "number") & (F.col(f"{n}.types") == "number")
    plain = lambda p: F.regexp_replace(F.lower(p), "[^\\p{L}\\p{N}.]", "")
    a, b = plain(F.col("old_path")), plain(F.col("new_path"))
    last = lambda p: F.element_at(F.split(p, "\\."), -1)
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    name = F.greatest(near, F.when(a == b, 1.0).when(last(a) == last(b), 0.6).when(last(a).contains(last(b)) | last(b).contains(last(a)), 0.5).otherwise(0.0))
    return F.when(both_num, number).otherwise(text), name


def _side_by_side(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Those pairs of names of which some file has both."""
    p = pairs.select("src_table", "old_path", "new_path").distinct()
    f = fields.where("path IS NOT NULL").select(*FILE, "path")
    a = f.alias("f").join(p.alias("p"), (F.col("f.src_table") == F.col("p.src_table")) & (F.col("f.path") == F.col("p.old_path"))).select("f.src_table", "f.writer_id", "f.file_no", "p.old_path", "p.new_path")
    g = f.select(*FILE, F.col("path").alias("new_path"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*FILE, "new_path")]
    return a.alias("a").join(g.alias("g"), same, "left_semi").select("src_table", "old_path", "new_path").distinct()


def renames(diff: DataFrame, fields: DataFrame) -> DataFrame:
    """(file, old_path, new_path): removed and added fields that are one. Candidates meet only within a file and equal types."""
    gone = diff.where("new IS NULL").select(*FILE, F.col("path").alias("old_path"), "old", F.col("old.types").alias("types"))
    come = diff.where("old IS NULL").select(*FILE, F.col("path").alias("new_path"), "new", F.col("new.types").alias("types"))
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in FILE] + [F.col("g.types") == F.col("c.types")]
    j = gone.alias("g").join(come.alias("c"), on).select(*(F.col(f"g.{c}").alias(c) for c in FILE), "old_path", "new_path", "old", "new")
    like, name = _score("old", "new")
    cand = j.withColumn("_c", like).withColumn("_s", F.col("_c") + 0.6 * name).where(F.col("_c") >= HINT).select(*FILE, "old_path", "new_path", "_c", "_s")
    sure = cand.groupBy("src_table", "old_path", "new_path").agg(F.max("_c").alias("_m")).where(F.col("_m") >= ALIKE).drop("_m")
    sure = sure.join(_side_by_side(sure, fields), ["src_table", "old_path", "new_path"], "left_anti")
    cand = cand.join(sure, ["src_table", "old_path", "new_path"])
    best = cand.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), F.col("old_path").alias("o"), F.col("new_path").alias("n")))).alias("a"))
    none = F.expr("named_struct('o', cast(array() as array<string>), 'n', cast(array() as array<string>))")
    add = lambda acc, f, x: F.concat(acc[f], F.array(x[f])).alias(f)
    pick = F.aggregate("a", none, lambda acc, x: F.when(F.array_contains(acc["o"], x["o"]) | F.array_contains(acc["n"], x["n"]), acc).otherwise(F.struct(add(acc, "o", x), add(acc, "n", x))))
    return best.select(*FILE, pick.alias("p")).select(*FILE, F.explode(F.arrays_zip("p.o", "p.n")).alias("z")).select(*FILE, F.col("z.o").alias("old_path"), F.col("z.n").alias("new_path"))


def changes(fields: DataFrame) -> DataFrame:
    """Every change: src_table, writer_id, file_no, change_kind, field_path, old_value, new_value. ``fields`` is read several times: give a written table."""
    from drawloom.storage import written

    diff = written(_differences(fields, neighbours(fields)), "drift")
    ren = written(renames(diff, fields), "renames")
    was, now = ren.select(*FILE, F.col("old_path").alias("path"), "new_path"), ren.select(*FILE, F.col("new_path").alias("path"))
    same = lambda l, r: [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in (*FILE, "path")]
    cols = lambda kind, path, old, new: [*(F.col(f"d.{c}").alias(c) for c in FILE), F.lit(kind).alias("change_kind"), F.col(path).alias("field_path"), old.alias("old_value"), new.alias("new_value")]
    d, empty = diff.alias("d"), F.lit("")
    gone, come = d.where("d.new IS NULL"), d.where("d.old IS NULL")
    parts = [
        come.join(now.alias("r"), same("d", "r"), "left_anti").select(*cols("added", "d.path", empty, F.col("d.new.types"))),
        gone.join(was.alias("r"), same("d", "r"), "left_anti").select(*cols("removed", "d.path", F.col("d.old.types"), empty)),
        gone.join(was.alias("r"), same("d", "r")).select(*cols("renamed", "d.path", F.col("d.old.types"), F.col("r.new_path"))),
        d.where("d.old IS NOT NULL AND d.new IS NOT NULL").select(*cols("retyped", "d.path", F.col("d.old.types"), F.col("d.new.types"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- one consistent table --------------------------------------------------------------------------------------------


def promote(kinds: set[str], numbers: set[str] = frozenset()) -> str:
    """The least type of the lattice that holds all: boolean, long, decimal, number (a double), array or string above them."""
    if len(kinds) != 1:
        return "string"
    kind = next(iter(kinds))
    if kind != "number" or not numbers:
        return kind
    if "big" in numbers:
        return "string"
    if "float" in numbers:
        return "number" if numbers <= {"float", "int53"} else "string"
    return "decimal" if "int38" in numbers else "long"


def aliases(pairs: list[tuple[str, str, int]], counts: dict[str, int]) -> dict[str, str]:
    """Each renamed path to its canonical name: of all paths linked by renames, the one in most files."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, _ in pairs:
        a, b = find(a), find(b)
        if a != b:
            hi, lo = (a, b) if (counts.get(a, 0), b) >= (counts.get(b, 0), a) else (b, a)
            up[lo] = hi
    return {x: find(x) for x in up}


#: A schema wider than this is refused: it goes to the driver.
MOST_PATHS = 20_000


def consistent(df: DataFrame, fields: DataFrame, change_log: DataFrame, meta: list[str]) -> DataFrame:
    """All records in one table: the ``meta`` columns as they are and a column per canonical field, cast to its promoted type.

    Only the schema (distinct paths with their types, and distinct renames) goes to the driver, refused beyond MOST_PATHS.
    """
    seen = fields.where("path IS NOT NULL").groupBy("path", "types").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("numbers")).limit(MOST_PATHS + 1).collect()
    if len(seen) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} different fields")
    ren = change_log.where("change_kind = 'renamed'").groupBy("field_path", "new_value").agg(F.count(F.lit(1)).alias("n")).limit(MOST_PATHS + 1).collect()
    if len(ren) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} different renames")
    counts: dict[str, int] = {}
    for r in seen:
        counts[r.path] = counts.get(r.path, 0) + r.n
    to = aliases(sorted((r.field_path, r.new_value, r.n) for r in ren), counts)
    kinds: dict[str, set[str]] = {}
    numbers: dict[str, set[str]] = {}
    for r in seen:
        kinds.setdefault(to.get(r.path, r.path), set()).update(r.types.split("|"))
        numbers.setdefault(to.get(r.path, r.path), set()).update(r.numbers)
    names: dict[str, list[str]] = {}
    for p in counts:
        names.setdefault(to.get(p, p), []).append(p)
    schema = df.select(*meta).schema.add("leaf", T.MapType(T.StringType(), T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keep = [], []
            for i, raw in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if (o := parse(raw)) is not None:
                    keep.append(i)
                    rows.append([(clean(p), clean(v) if isinstance(v, str) else json.dumps(v)) for p, v in dict(leaves(o)).items() if v is not None])
            head = pa.Table.from_batches([b]).select(range(b.num_columns - 1)).take(pa.array(keep, pa.int64()))
            yield from head.append_column("leaf", pa.array(rows, pa.map_(pa.string(), pa.string()))).to_batches()

    x = df.select(*meta, F.col("raw").cast("string").alias("raw")).mapInArrow(run, schema)
    cast = {"number": "double", "long": "bigint", "decimal": "decimal(38,0)", "boolean": "boolean", "array": "array<string>", "string": "string"}
    cols, used = [], {m.lower() for m in meta}
    for c in sorted(names):
        k = promote(kinds[c], numbers[c])
        v = F.coalesce(*(F.element_at("leaf", p) for p in sorted(names[c], key=lambda p: (-counts[p], p))))
        v = F.from_json(v, "array<string>") if k == "array" else v.try_cast(cast[k])
        name = c.replace(".", "__")
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        cols.append(v.alias(name))
    return x.select(*meta, *cols)
