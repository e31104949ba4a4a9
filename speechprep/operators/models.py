"""Hooks for row functions and for injected models (tokenizer, codec, generator).

A *factory* is called once per task and returns a callable; what it loads stays in
the Python worker for all rows of that task. A row that fails gives null and a
message in ``error``, and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


# Array elements that one Arrow batch of model output may hold: a few codes of
# input can become a long waveform.
CHUNK_VALUES = 1_000_000
# Rows, and about how many bytes of their values, that are Python objects at once.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1_024, 4 << 20


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Arrow columns in stretches of rows, so that a batch of long rows is not turned into Python values at once."""
    sizes = np.ones(len(columns[0]), np.int64)
    for column in columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist(), 1):
        held += size
        if held >= BYTES_AT_ONCE or at - start >= ROWS_AT_ONCE or at == len(sizes):
            yield tuple(column.slice(start, at - start) for column in columns)
            start, held = at, 0


def _narrowed(value, kind: pa.DataType):
    """A numpy array as numbers of the list type it goes to; Arrow would convert them one by one."""
    if isinstance(value, dict) and pa.types.is_struct(kind):
        return {f.name: _narrowed(value.get(f.name), f.type) for f in kind}
    if isinstance(value, np.ndarray) and value.ndim == 1 and pa.types.is_list(kind):
        to = kind.value_type
        whole = pa.types.is_integer(to) and value.dtype.kind in "iu"
        if (whole or pa.types.is_floating(to) and value.dtype.kind == "f") and value.dtype != to.to_pandas_dtype():
            return pa.array(value).cast(to).to_numpy(zero_copy_only=False)  # fails where a number does not fit
    return value


def _values(array: pa.Array) -> list:
    """Python values of an Arrow array: nulls are None, integers stay integers, number lists are numpy arrays."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    of = array.type.value_type if pa.types.is_list(array.type) else None
    if of is None or not (pa.types.is_integer(of) or pa.types.is_floating(of)):
        return array.to_pylist()
    return [
        None if not x.is_valid
        else x.as_py() if x.values.null_count
        else x.values.to_numpy(zero_copy_only=False)
        for x in array
    ]


def filter_rows(df: DataFrame, keep: Column | Callable[..., bool], *inputs: str) -> DataFrame:
    """Keep rows by a Column, or by a Python test of the named columns."""
    if isinstance(keep, Column):
        return df.filter(keep)

    @F.arrow_udf("boolean")
    def test(*columns: pa.Array) -> pa.Array:
        rows = (row for some in pieces(columns) for row in zip(*map(_values, some)))
        return pa.array([bool(keep(*row)) for row in rows], pa.bool_())

    return df.filter(test(*[F.col(c) for c in inputs]))


def map_rows(
    df: DataFrame, fn: Callable[[dict], dict], schema: str, remove: list[str] = ()
) -> DataFrame:
    """Apply a row function; columns of ``schema`` are added or replaced.

    A row on which ``fn`` raises keeps its other columns, gets nulls in those of
    ``schema`` and says why in ``error``. Columns that are kept pass as they are.
    """
    added = T.StructType.fromDDL(schema)
    names = [f.name for f in added]
    keep = [f for f in df.schema if f.name not in {*names, *remove, "error"}]
    kept = [f.name for f in keep]
    shape = T.StructType([*keep, *added, T.StructField("error", T.StringType())])
    types = {f.name: to_arrow_type(f.dataType) for f in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, errors = [], []
            for row in batch.to_pylist():
                try:
                    made.append(fn(row))
                    errors.append(None)
                except Exception as fault:
                    made.append({})
                    errors.append(str(fault) or type(fault).__name__)
            new = [pa.array([m.get(n) for m in made], types[n]) for n in names]
            columns = [*[batch.column(n) for n in kept], *new, pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names, "error"])

    return df.mapInArrow(run, shape)


def _cost(row: tuple) -> int:
    """Elements of a row's longest input."""
    return max([1, *[len(value) for value in row if hasattr(value, "__len__")]])


def single_calls(model: Callable, simpler: Callable | None) -> Callable[[list[tuple]], list[tuple]]:
    """Rows -> ``(value, error)`` of each, one call a row and a second one where the first failed."""

    def call(row: tuple):
        try:
            try:
                return model(*row), None
            except Exception:
                if simpler is None:
                    raise
                return model(*simpler(*row)), None
        except Exception as fault:
            return None, str(fault) or type(fault).__name__

    return lambda rows: [call(row) for row in rows]


def batched_calls(
    model: Callable, simpler: Callable | None, budget: int, cost: Callable[[tuple], int]
) -> Callable[[list[tuple]], list[tuple]]:
    """Rows -> ``(value, error)`` of each, by calls on lists of rows of like length.

    A call that fails is halved until the failing row is alone, and only that row is tried on simpler settings.
    """

    def called(rows: list[tuple]) -> list[tuple]:
        values = list(model(rows))
        if len(values) != len(rows):
            raise ValueError(f"{len(values)} results for {len(rows)} rows")
        return [
            (None, str(v) or type(v).__name__) if isinstance(v, Exception) else (v, None) for v in values
        ]

    def call(rows: list[tuple]) -> list[tuple]:
        try:
            return called(rows)
        except Exception as fault:
            if len(rows) > 1:
                half = len(rows) // 2
                return call(rows[:half]) + call(rows[half:])
            if simpler is not None:
                try:
                    return called([tuple(simpler(*rows[0]))])
                except Exception as again:
                    fault = again
            return [(None, str(fault) or type(fault).__name__)]

    def run(rows: list[tuple]) -> list[tuple]:
        costs = [cost(row) for row in rows]
        order = sorted(range(len(rows)), key=costs.__getitem__)
        done: list = [None] * len(rows)
        start = 0
        for end in range(1, len(order) + 1):
            # Padded to its longest row, the next one, a call would hold more than the budget.
            if end == len(order) or costs[order[end]] * (end + 1 - start) > budget:
                some = order[start:end]
                for at, result in zip(some, call([rows[at] for at in some])):
                    done[at] = result
                start = end
        return done

    return run


# Rows whose inputs hold up to so many budgets are sorted by length at once.
WINDOW = 16


def _windows(rows: list[tuple], budget: int, cost: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += cost(row)
        if held >= WINDOW * budget:
            yield some
            some, held = [], 0
    if some:
        yield some


def apply_model(
    df: DataFrame,
    factory: Callable[[], Callable],
    inputs: list[str],
    out: str,
    schema: str,
    simpler: Callable[..., tuple] | None = None,
    budget: int | None = None,
    cost: Callable[[tuple], int] = _cost,
) -> DataFrame:
    """Add ``out`` and ``error``: what the model gives for each row's inputs.

    With ``simpler``, a failed call is tried once more on ``simpler(*inputs)``. Inputs are Python values or,
    for lists of numbers, numpy arrays; what a row gets does not depend on its neighbours. Of several
    steps ``error`` keeps the first fault of a row.

    With a ``budget`` the model takes a list of rows (tuples of inputs) and gives a list of results, of which an
    exception is that row's fault. Rows of like length go into a call together, as many as hold no more than
    ``budget`` elements when all are padded to the longest (``cost`` is the length of a row); a longer row is a
    call of its own. Results come back in the order of the rows.
    """
    shape = f"value {schema}, error string"
    kind = to_arrow_type(T.StructType.fromDDL(f"value {schema}")[0].dataType)

    def size(value) -> int:
        parts = value.values() if isinstance(value, dict) else [value]
        return sum(len(part) for part in parts if hasattr(part, "__len__"))

    def frame(done: list) -> pa.Array:
        values = pa.array([_narrowed(value, kind) for value, _ in done], kind)
        return pa.StructArray.from_arrays(
            [values, pa.array([error for _, error in done], pa.string())], ["value", "error"]
        )

    @F.arrow_udf(shape)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = factory()
        call = single_calls(model, simpler) if budget is None else batched_calls(model, simpler, budget, cost)

        for batch in batches:
            # One input comes as a bare array, several as a tuple of them.
            columns = batch if isinstance(batch, tuple) else (batch,)
            rows = (row for some in pieces(columns) for row in zip(*map(_values, some)))
            done, held = [], 0
            for some in ([row] for row in rows) if budget is None else _windows(rows, budget, cost):
                results = call(some)
                done += results
                held += sum(size(value) for value, _ in results)
                if held >= CHUNK_VALUES:
                    yield frame(done)
                    done, held = [], 0
            yield frame(done)

    # Not deterministic: a later filter on the result must not run the model once more.
    run = run.asNondeterministic()
    called = df.withColumn("_called", run(*[F.col(c) for c in inputs]))
    error = F.col("_called.error")
    if "error" in df.columns:
        error = F.coalesce("error", error)
    return called.withColumns({out: F.col("_called.value"), "error": error}).drop("_called")


def apply_tokenizer(
    df: DataFrame, factory, text: str = "prompt", out: str = "text_ids", budget: int | None = None
) -> DataFrame:
    """Text to ids by an external tokenizer, special tokens included; ``budget`` counts characters."""
    return apply_model(df, factory, [text], out, "array<int>", budget=budget)


def apply_encoder(df: DataFrame, factory, *inputs: str, budget: int | None = None) -> DataFrame:
    """Waveform (or what the factory's model takes) to code layers ``l1, l2, l3``; ``budget`` counts samples."""
    layers = "struct<l1: array<int>, l2: array<int>, l3: array<int>>"
    coded = apply_model(df, factory, list(inputs) or ["samples"], "_layers", layers, budget=budget)
    return coded.withColumns({n: F.col(f"_layers.{n}") for n in ("l1", "l2", "l3")}).drop(
        "_layers"
    )


def apply_decoder(df: DataFrame, factory, out: str = "samples", budget: int | None = None) -> DataFrame:
    """Three code layers to a waveform; ``budget`` counts codes of the longest layer."""
    return apply_model(df, factory, ["l1", "l2", "l3"], out, "array<float>", budget=budget)


def apply_generator(
    df: DataFrame,
    factory,
    inputs: list[str],
    simpler: Callable[..., tuple] | None = None,
    out: str = "ids",
    budget: int | None = None,
) -> DataFrame:
    """Prompt ids and settings to generated ids, with one retry on simpler settings; ``budget`` counts prompt ids."""
    return apply_model(df, factory, inputs, out, "array<int>", simpler, budget)
