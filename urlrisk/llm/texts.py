"""Small helpers on texts and columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word is a run of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def dealt(groups: int) -> Column:
    """A number from 0 to groups - 1 for each row of a stored table. A hash of the row's
    place, so groups are even whatever the partitions' sizes."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))


#: Bits of the filter in `doubtful`: 1024 rows of 4 KB, whatever the number of ids.
FILTER_BITS = 1 << 25


def doubtful(rows: DataFrame, ids: DataFrame, key: str, scratch) -> DataFrame:
    """`rows` with `_doubtful`: false only where `key` is surely not among those of `ids`
    (any numbers in a column of that name). A broadcast bitmap of hashes of bounded size,
    so wide rows stay where they are and only doubtful ones need a join."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = ids.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")
    )
    placed = rows.withColumn("_at", at).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    bit = F.bitmap_bit_position("_at").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))
    joined = placed.join(F.broadcast(scratch.put(bits, "bits")), "_bucket", "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias("_doubtful"))


def utf8(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes (None stays None)."""
    import pyarrow as pa

    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def slices(batch, rows: int):
    """An Arrow batch in pieces of at most `rows` rows, to bound what Python holds."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns whose names clash (in any case) with those that an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def add_columns(docs: DataFrame, text: str, added: str, compute, carry: list[str] | None = None, rows: int = 512) -> DataFrame:
    """Columns of `docs` (or those in `carry`) with the columns `added` (a DDL list), which
    `compute` makes from the Arrow column of a few texts at a time. One narrow pass; the
    text crosses to Python once. Columns named like an added one are replaced."""
    from pyspark.sql import types as T

    extra = T.StructType.fromDDL(added)
    rest = without(docs.select(*[F.col(f"`{c}`") for c in carry]) if carry is not None else docs, *extra.names)
    keeps = text in rest.columns
    given = rest.columns if keeps else [*rest.columns, text]
    at = given.index(text)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in extra.fields]
        for whole in batches:
            for batch in slices(whole, rows):
                made = compute(batch.column(at))
                columns = batch.columns if keeps else batch.columns[:-1]
                new = [pa.array(c, k) for c, k in zip(made, kinds, strict=True)]
                yield pa.record_batch([*columns, *new], names=[*rest_names, *extra.names])

    rest_names = rest.columns
    return docs.select(*[F.col(f"`{c}`") for c in given]).mapInArrow(run, T.StructType([*rest.schema.fields, *extra.fields]))
