"""Best-fit packing of token sequences (best-two-fit).

Documents are tokenized in one pass and cut into pieces of at most the capacity. Words
are tokenized one by one through a bounded cache: the tokenizer splits at white space
anyway, so the ids are those of the whole text. Pieces are then dealt evenly, by row
and not by key, to groups of bounded size, and each group is packed by itself: bins are
filled greedily, largest piece first; a bin that still has a gap gives up its smallest
piece for the two unpacked ones that fit the larger gap best, if they fit tighter. A
group wastes about one part-filled bin, whatever the size of the input. Rows that carry
their ids can be packed where they are read, which shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlrisk.llm.scratch import Scratch
from urlrisk.llm.texts import dealt, slices, utf8, without

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"

#: Pieces in one packing group, on average.
GROUP_ROWS = 8192

#: Words whose ids a worker keeps; beyond, the cache starts anew (ids do not depend on it).
CACHE_WORDS = 600_000


#: Marks that stand alone after an ASCII letter.
_MARKS = frozenset(b".,;:!?")

#: How byte-level vocabularies write a byte: visible Latin-1 characters as themselves, the
#: others as the characters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _plain(word: str) -> bool:
    """Whether a word is lower-case Latin letters only, which the tokenizer's model gets
    whole and as they are."""
    from unicodedata import is_normalized

    return word.isalpha() and word == word.lower() and max(word) < "\u0250" and is_normalized("NFC", word)


#: Bytes of text whose words are held at once.
PART_BYTES = 1 << 20


class _Words:
    """Ids of a word as little-endian 32-bit bytes, in `ids`."""

    def __init__(self, path: str | None, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.ids: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)

    def need(self, words: set[bytes]) -> None:
        """Load what is missing of `words`."""
        new = words.difference(self.ids)
        if not new:
            return
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids.clear()
            new = words
        # A mark after a letter is a token of its own: such words follow from their parts.
        marked = [w for w in new if w[-1] in _MARKS and len(w) > 1 and 97 <= w[-2] <= 122]
        plain = new.difference(marked)
        plain.update([w[:-1] for w in marked], [w[-1:] for w in marked])
        self._load(plain.difference(self.ids))
        ids = self.ids
        for w in marked:
            ids[w] = ids[w[:-1]] + ids[w[-1:]]

    def _load(self, words: set[bytes]) -> None:
        from array import array

        ids, tokenize, rest = self.ids, self.tokenizer.model.tokenize, []
        for w in words:
            if w.isalpha() and w.islower():  # ASCII letters are written as they are
                ids[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
            elif _plain(w.decode()):
                tokens = tokenize(w.decode("latin-1").translate(_BYTE_LETTERS))
                ids[w] = array("I", [t.id for t in tokens]).tobytes()
            else:
                rest.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        for w, e in zip(rest, found, strict=True):
            ids[w] = array("I", e.ids).tobytes()


_loaded: dict[tuple, _Words] = {}  # one per worker process


def _words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part. The tokenizer ignores case, so words are taken
    in lower case, but not where a special token may stand."""
    text = text if b"<|" in text else text.lower()
    at = 0
    while at < len(text):
        end = at + PART_BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def _tokenize(batches: Iterator, capacity: int, path: str | None, name: str) -> Iterator:
    import pyarrow as pa

    if (path, name) not in _loaded:
        _loaded[path, name] = _Words(path, name)
    cache, width = _loaded[path, name], 4 * capacity
    names = ("doc_id", "piece", "start", "length", "ids")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for whole in batches:
        for batch in slices(whole, 256):
            rows = []
            for doc, ids in _ids_of(zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True), cache):
                for k, at in enumerate(range(0, len(ids), width)):
                    piece = ids[at : at + width]
                    rows.append((doc, k, at // 4, len(piece) // 4, piece))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _ids_of(docs: Iterable, cache: _Words) -> Iterator[tuple]:
    """Documents with their ids, in order. Words are looked up for many short texts at once,
    and part by part in long ones."""
    held, size = [], 0

    def looked_up():
        cache.need(set().union(*[words for _, words, _ in held]))
        for key, words, last in held:
            yield key, b"".join(map(cache.ids.__getitem__, words)), last

    def documents(parts):
        for key, ids, last in parts:
            done.append(ids)
            if last:
                yield key, b"".join([*done, b"\0\0\0\0"])
                done.clear()

    done: list[bytes] = []
    for key, text in docs:
        text = text or b""
        for words in _words_of(text):
            held.append((key, words, False))
            size += min(len(text), PART_BYTES)
            if size >= PART_BYTES:
                yield from documents(looked_up())
                held, size = [], 0
        held.append((key, [], True))
    yield from documents(looked_up())


def pieces(
    docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, tokenizer: str = "word_bpe_49k.json",
) -> DataFrame:
    """Token pieces of `docs` (`doc_id, text`): `doc_id, piece, start, length, ids`.

    A document's ids end with id 0; longer ones are cut every `capacity` ids. `ids` are
    little-endian unsigned 32-bit numbers. Null and empty texts are the id 0 alone. The
    tokenizer's file is `tokenizer_path`, or the named public one as each worker finds it.
    It must be byte-level, split at white space and before a mark that follows a letter,
    take a run of letters whole and ignore case, as `word_bpe_49k.json` does.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(lambda it: _tokenize(it, capacity, tokenizer_path, tokenizer), PIECE_SCHEMA)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in `lengths`; every length is from 1 to the capacity."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} tokens in bins of {capacity}")
        stacks.setdefault(n, []).append(i)
    present = 0  # bit n: an unpacked piece of length n
    for n in stacks:
        present |= 1 << n

    def largest(limit: int) -> int:
        """The greatest unpacked length up to `limit`; 0 if there is none."""
        return max((present & ((1 << (limit + 1)) - 1)).bit_length() - 1, 0)

    def take(n: int) -> int:
        nonlocal present
        i = stacks[n].pop()
        if not stacks[n]:
            present &= ~(1 << n)
        return i

    def best_pair(room: int, least: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the greatest sum above `least` and up to `room`."""
        best, a = None, largest(room - 1)
        while a and 2 * a > least:
            limit = min(a, room - a)
            if limit == a and len(stacks[a]) < 2:
                limit -= 1
            b = largest(limit) if limit > 0 else 0
            if b and a + b > least:
                best, least = (a, b), a + b
                if least == room:
                    break
            a = largest(a - 1)
        return best

    bins = []
    while present:
        members, gap = [], capacity
        while gap and (n := largest(gap)):
            members.append((n, take(n)))
            gap -= n
        if gap and present:
            smallest, index = members[-1]
            if pair := best_pair(gap + smallest, smallest):
                members[-1:] = [(n, take(n)) for n in pair]
                stacks[smallest].append(index)
                present |= 1 << smallest
        bins.append([i for _, i in members])
    return bins


def _pack_group(table, capacity: int, first: int | None = None):
    """A group with its places; sequences are numbered from `first`, or by the group."""
    import numpy as np
    import pyarrow as pa

    lengths = table.column("length").to_pylist()
    first = table.column("_group")[0].as_py() << 32 if first is None else first
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, members in enumerate(best_two_fit(lengths, capacity)):
        at = 0
        for i in members:
            sequence[i], offset[i] = first + k, at
            at += lengths[i]
    table = table.drop_columns(["_group"])
    return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def _pack_runs(batches: Iterator, capacity: int, group_rows: int) -> Iterator:
    """Groups of successive rows of a task, whose number is in `_group`. The last group
    takes what is left, so that no group is small unless the task is."""
    import pyarrow as pa

    held, rows, first = [], 0, None

    def packed(table):
        nonlocal first
        first = table.column("_group")[0].as_py() << 40 if first is None else first
        yield from _pack_group(table, capacity, first).to_batches()
        first += table.num_rows  # a sequence has a row at least

    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        while rows >= 2 * group_rows:
            table = pa.Table.from_batches(held)
            yield from packed(table.slice(0, group_rows))
            held, rows = table.slice(group_rows).to_batches(), rows - group_rows
    if rows:
        yield from packed(pa.Table.from_batches(held))


def pack(rows: DataFrame, capacity: int = 2048, group_rows: int = GROUP_ROWS, in_place: bool = False) -> DataFrame:
    """`rows` with `sequence_id` and `offset`. They need a `length` (1 to the capacity);
    all their other columns stay, token ids too if the caller keeps them. Columns named
    like an added one are replaced. Equal rows are packed one by one; an empty table
    gives an empty table. `rows` are written once to the shared folder, so that groups
    do not depend on a recomputation. `in_place` packs the rows of each task that reads
    them back, for rows too wide to shuffle; else they are dealt evenly to groups."""
    scratch = Scratch(rows.sparkSession, "packing")
    table = scratch.put(without(rows, "sequence_id", "offset", "_group"), "pieces")
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if in_place:
        placed = table.withColumn("_group", F.spark_partition_id().cast("long"))
        return placed.mapInArrow(lambda it: _pack_runs(it, capacity, group_rows), schema)
    groups = max(1, -(-table.count() // group_rows))
    grouped = table.withColumn("_group", dealt(groups))
    return grouped.groupBy("_group").applyInArrow(lambda t: _pack_group(t, capacity), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: `sequence_id, ids`, the pieces' ids in order of
    offset. A sequence is at most one capacity long, so a group is small."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p")).select(
        "sequence_id", F.aggregate("_p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")
    )
