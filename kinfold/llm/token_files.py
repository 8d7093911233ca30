"""Token ids of a corpus as flat binary files, read back by memory map.

A corpus is a folder: each part has ``ids-*.bin``, its documents' ids one after another as little-endian unsigned
integers of 16 or 32 bits, ``offsets-*.bin``, 64-bit places where its documents begin, counted from the part's own
first id and closed by its last, and ``docs-*.bin``, their 64-bit document ids. ``manifest`` is a Parquet table with one row a part. Parts are ranges of the
document id, so that ids lie in its order; the first id of a part in the whole corpus, ``base``, is the prefix
sum of the sizes of all parts before it, taken over the manifest alone.

Texts are dealt to the parts once and encoded where they are written, so neither ids nor offsets are ever
shuffled. Files are named by attempt, and the manifest lists those of the attempts whose rows Spark kept: a
lost executor's files are written again under other names and its own are never read. The folder has to be one that all executors
mount, or a store that ``pyarrow.fs`` knows by its URI, which is read in blocks instead of mapped.
"""

from __future__ import annotations

import functools
import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.text import LOWER, SEPARATOR, id_text, map_batches, pieces, word_spans
from kinfold.session import scratch_dir

#: Bytes of text, and documents, that a part is meant to hold.
PART_TEXT, PART_DOCS = 64 << 20, 1 << 22
#: Bytes of text that are encoded at a time; a single longer text is taken whole.
ENCODED = 1 << 21
#: Ids that a reader turns into rows at a time; a longer document is taken whole.
READ_IDS = 1 << 20
#: Distinct pieces whose ids an encoder keeps, and how many it asks the library for as one text.
KNOWN, ASKED = 1 << 18, 1000
#: Put between words that the library cuts itself.
MARK = b"\x01"
#: Letters, digits and what is neither, of lower-case ASCII; the letters that make an ending by themselves.
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.full(256, _SIGN, np.int8)
_CLASS[97:123], _CLASS[48:58], _CLASS[SEPARATOR] = _LETTER, _DIGIT, 0
_SHORT = np.frombuffer(b"stmd", np.uint8)
#: First byte of U+00C0 to U+00FF, and all bytes that words which are cut consist of.
_LATIN = 0xC3
_CUT = bytes([*range(0xC0), _LATIN])
_MANIFEST = "part int, name string, n_docs long, n_null long, n_ids long, id_bytes int"

#: From the bytes of some texts and where each begins, closed by the end of the last, to all ids and the number of each.
Encoder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@functools.cache
def library_encoder(path: str) -> Encoder:
    """Any ``tokenizers`` vocabulary, every text given to the library as it is."""
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(path)

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes()
        return _joined(made, [text[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
    return encode


def _joined(made, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in made.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


@functools.cache
def piece_encoder(path: str) -> Encoder:
    """The same ids as ``library_encoder``, but the library is asked for each distinct piece of text once.

    Only for vocabularies that, as that of ``cut_pieces``, lower-case, drop white space and cut at its classes before they
    merge, and mark the last token of a piece by ``</w>``: a text's ids are those of its pieces in turn. Pieces it has seen are
    kept up to a bound by the worker, for all its tasks; when it is met all are forgotten. Texts with a special token's name are left to the library whole.
    """
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(path)
    special = [t.content.encode() for t in made.get_added_tokens_decoder().values()]
    last = np.zeros(made.get_vocab_size(), bool)
    for token, i in made.get_vocab().items():
        last[i] = token.endswith("</w>")
    mark = _joined(made, [MARK])[0]
    known: dict[bytes, int] = {}
    flat, starts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def asked(pieces: list[bytes], between: bytes, ends: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece, many pieces to a text; ``ends`` tells the last id of each."""
        ids, _ = _joined(made, [between.join(pieces[i:i + ASKED] + [b""]) for i in range(0, len(pieces), ASKED)])
        sizes = np.diff(np.flatnonzero(ends(ids)) + 1, prepend=0)
        if len(sizes) != len(pieces):
            raise ValueError("the vocabulary does not cut text where this encoder does")
        return ids, sizes

    def learn(new: list[bytes]) -> None:
        """Pieces that were cut end with a token that is marked so; after other words a mark of their own is put."""
        plain, words, rest = [], [], []
        for w in new:
            (plain if not w.translate(None, _CUT) else rest if MARK in w else words).append(w)
        ids, sizes = asked(plain, b" ", lambda x: last[x])
        more, spans = asked(words, b" " + MARK + b" ", lambda x: x == mark)
        own, lengths = _joined(made, rest)
        flat[0] = np.concatenate([flat[0], ids, more[more != mark], own])
        starts[0] = np.concatenate([starts[0], starts[0][-1] + np.cumsum(np.concatenate([sizes, spans - 1, lengths]))])
        known.update(zip(plain + words + rest, range(len(known), len(known) + len(new))))

    def of_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > KNOWN:
            known.clear()
            flat[0], starts[0] = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        pieces, first = cut_pieces(data, offsets)
        found = pieces.dictionary_encode()
        names = found.dictionary.to_pylist()
        if new := [w for w in names if w not in known]:
            learn(new)
        at = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        begin = starts[0][at]
        sizes = starts[0][at + 1] - begin
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return flat[0][np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)], np.diff(ends[first])

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes()
        if not any(s in text for s in special):
            return of_pieces(data, offsets)
        each = [text[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        made_of = [_joined(made, [t]) if any(s in t for s in special) else of_pieces(
            np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in each]
        return np.concatenate([m[0] for m in made_of]), np.concatenate([m[1] for m in made_of])
    return encode


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of some texts, and the number of pieces before each text.

    A word of ASCII and the letters from U+00C0 to U+00FF, which no normal form changes, is lower-cased and cut into runs of
    letters, single digits, runs of anything else, and the English endings ``'s 't 're 've 'm 'll 'd`` where nothing but
    a letter or digit precedes the quote. A word that holds any other character is one piece, as it is.
    """
    starts, ends, _ = word_spans(data, offsets)
    low, inside = LOWER[data], ~SEPARATOR[data]
    kind = _CLASS[low]
    odd = data >= 128
    latin = np.flatnonzero(data == _LATIN)  # U+00C0 and on: this byte and one more
    odd[latin] = odd[latin + 1] = False
    second = low[latin + 1]
    sign = (second == 0x97) | (second == 0xB7)  # the signs of multiplication and division
    kind[latin] = kind[latin + 1] = np.where(sign, _SIGN, _LETTER)
    low[latin + 1] = np.where((second <= 0x9E) & ~sign, second + 32, second)
    high = np.zeros(len(data) + 1, np.int32)
    np.cumsum(odd, out=high[1:])
    other = high[ends] > high[starts]
    whole = np.zeros(len(data) + 1, np.int8)
    whole[starts[other]] += 1
    np.subtract.at(whole, ends[other], 1)
    whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
    kind[whole] = 0
    new = inside & (kind == _DIGIT)
    new[1:] |= inside[1:] & (kind[1:] != kind[:-1])
    begins = np.zeros(len(data) + 3, bool)  # and what is behind the end begins nothing that an ending could reach into
    begins[starts], begins[len(data):] = True, True
    new |= begins[:len(data)]
    padded = np.concatenate([low, np.zeros(3, np.uint8)])
    quote = np.flatnonzero(new & (low == 39) & ~whole)
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, _SHORT) & ~begins[quote + 1]
    long = ~begins[quote + 1] & ~begins[quote + 2] & (
        ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
    new = np.concatenate([new, np.zeros(3, bool)])
    for hit, size in ((quote[short], 2), (quote[long], 3)):
        new[hit + 1] = False
        behind = hit + size
        new[behind] |= (np.concatenate([inside, np.zeros(3, bool)]))[behind]
    new = np.flatnonzero(new[:len(data)])
    packed = np.where(whole, data, low)[inside]
    before = np.cumsum(inside, dtype=np.int32) - inside
    places = np.append(before[new], len(packed)).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(places), pa.py_buffer(packed)])
    return made, np.searchsorted(new, offsets)


def _place(root: str) -> tuple:
    """The file system of a folder and its path there."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def written_files(docs: DataFrame, encoder: Callable[[], Encoder], end: int, vocabulary: int, root: str,
                  part_text: int = PART_TEXT) -> None:
    """Write the ids of all rows to the folder ``root``, each document's closed by the id ``end``.

    Documents come in ascending order of ``doc_id``, rows without one first; rows that repeat an id by a hash
    of the text. A null or empty text is the end id alone. Ids are 16 bits wide where ``vocabulary``, the number of
    ids there are, allows. ``encoder()`` is called in the worker. No rows: no files, and an empty manifest.
    """
    rows = id_text(docs).withColumns({"turn": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(-(-size[0] // part_text), -(-size[1] // PART_DOCS), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(parts, "doc_id", "turn", "row").sortWithinPartitions("doc_id", "turn", "row")
    kind = np.dtype("<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        encode, (store, folder) = encoder(), _place(root)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        docs_n = nulls = at = 0
        with store.open_output_stream(f"{folder}/ids-{name}.bin") as ids_out, \
                store.open_output_stream(f"{folder}/offsets-{name}.bin") as offsets_out, \
                store.open_output_stream(f"{folder}/docs-{name}.bin") as docs_out:
            for batch in (b for some in ((first,), filled) for b in some):
                for low, high, data, offsets in pieces(batch, size=ENCODED):
                    own = batch.column("doc_id").slice(low, high - low)
                    ids, sizes = encode(data, offsets)
                    ids_out.write(np.insert(ids, np.cumsum(sizes), end).astype(kind).tobytes())
                    sizes = sizes + 1
                    offsets_out.write((at + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
                    docs_out.write(own.fill_null(0).to_numpy().astype("<i8").tobytes())
                    at, docs_n, nulls = at + int(sizes.sum()), docs_n + len(sizes), nulls + own.null_count
            offsets_out.write(np.int64(at).astype("<i8").tobytes())
        yield {"part": [task.partitionId()], "name": [name], "n_docs": [docs_n], "n_null": [nulls], "n_ids": [at],
               "id_bytes": [kind.itemsize]}

    store, folder = _place(root)
    store.create_dir(folder, recursive=True)
    map_batches(dealt, run, _MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row a part, with ``base``, the ids of all parts before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").withColumn(
        "base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _mapped(store, path: str, kind: str, count: int) -> np.ndarray:
    from pyarrow import fs
    if not count:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", shape=(count,))
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind, count)


def read_back(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of a folder, from the files.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as little-endian unsigned 32-bit
    integers, whatever their width in the file. ``with_ids`` adds ``ids``.
    """
    table = manifest(spark, root)
    readers = min(max(1, table.count()), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, folder = _place(root)
        for part in (row for b in batches for row in b.to_pylist()):
            ids = _mapped(store, f"{folder}/ids-{part['name']}.bin", f"<u{part['id_bytes']}", part["n_ids"])
            offsets = _mapped(store, f"{folder}/offsets-{part['name']}.bin", "<i8", part["n_docs"] + 1)
            docs = _mapped(store, f"{folder}/docs-{part['name']}.bin", "<i8", part["n_docs"])
            at = 0
            while at < part["n_docs"]:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1)
                own = ids[offsets[at]:offsets[to]].astype("<u4")
                cuts = np.array(offsets[at:to + 1]) - offsets[at]
                lists = [own[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                out = {"doc_id": pa.array(np.array(docs[at:to]), mask=np.arange(at, to) < part["n_null"]),
                       "start": part["base"] + np.array(offsets[at:to]), "n_tokens": np.diff(cuts),
                       "ids_crc32": [zlib.crc32(x.tobytes()) for x in lists]}
                yield out | {"ids": [x.astype(np.int64) for x in lists]} if with_ids else out
                at = to
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return map_batches(table.repartitionByRange(readers, "part"), run, schema)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared place of the session."""
    return f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
