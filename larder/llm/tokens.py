"""Token ids in Arrow files of equal-length sequences.

A part is a pair of Arrow files.  `<part>.ids.arrow` holds batches of two fixed-size lists:
`ids` (uint16 where the vocabulary allows it, else uint32) and `mask` (true for a token,
false for padding); row i holds the tokens i * length to (i + 1) * length - 1 of the part.
`<part>.docs.arrow` holds doc_id, the document's first token in the part and its number of
tokens, in the order of the part.  Both open as memory maps, so a sequence, its mask or a
document's tokens are slices of the file: nothing is decoded or copied.
"""

import json
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.llm.common import new_folder, small_batches, stored

SEQUENCE = 2048
BATCH_ROWS = 256
MEMO, MEMO_BYTES = 400_000, 32 << 20
LEARN_BYTES, LEARN_CHUNKS = 2 << 20, 8192

# Latin-1 letters, then punctuation: the tokenizer cuts them the same way, and neither its
# normalizer nor its contractions see across the cut.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")

# The parts of a tokenizer file under which white space is dropped, never
# joined across, and a word of these letters goes lower-cased and byte by byte to the model.
NORMALIZERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_white_space(spec):
    """Whether a tokenizer, by its file, encodes the pieces between white space each for itself."""
    normalizer, cutter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    first = (cutter.get("pretokenizers") or [{}])[0]
    rest = [x.get("type") for x in (cutter.get("pretokenizers") or [])[1:]]
    return (
        normalizer.get("normalizers") == NORMALIZERS
        and first == split and rest == ["ByteLevel"]
        and spec["model"]["type"] == "BPE"
        and not any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
    )


class Memo(dict):
    """Numbers of keys and, by number, their values: those used lately, bounded in number and bytes.

    A key not met is numbered and noted in `new`; its value must follow.  Once there are too
    many the numbers start anew, and keys of the last generation bring their values along.
    """

    def __init__(self, most=None, most_bytes=None):
        self.most, self.most_bytes = most or MEMO, most_bytes or MEMO_BYTES
        self.values_of, self.new, self.old, self.size = [], [], {}, 0

    def __missing__(self, key):
        number = self[key] = len(self.values_of)
        value = self.old.get(key)
        self.values_of.append(value)
        if value is None:
            self.new.append(key)
        return number

    def renew(self):
        """Between two uses: starts a generation when this one is full."""
        if len(self) > self.most or self.size > self.most_bytes:
            self.old = dict(zip(self, self.values_of))
            self.clear()
            self.values_of, self.size = [], 0

    def learn(self, keys, values):
        values_of = self.values_of
        for key, value in zip(keys, values):
            values_of[self[key]] = value
        self.size += sum(map(len, keys)) + sum(map(len, values))


class Encoder:
    """Ids of whole texts by a tokenizers file; pieces between white space are remembered.

    A tokenizer whose file does not say that the pieces are encoded each for itself gets whole
    texts, and nothing is remembered.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.splits = splits_at_white_space(json.loads(self.tokenizer.to_str()))
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.chunks, self.words = Memo(), Memo()
        # How the tokenizer writes the bytes of each letter outside ASCII.
        letters = [chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha()] if self.splits else []
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str if letters else None
        self.spelled = {ord(x): cut(x)[0][0] for x in letters}

    def _whole(self, text):
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _learn_words(self, words):
        """Ids of lower-cased words of Latin-1 letters by the model alone: nothing else changes them."""
        memo, tokenize, spelled = self.words, self.model.tokenize, self.spelled
        memo.renew()
        numbers = [memo[w] for w in words]
        new, memo.new = memo.new, []
        memo.learn(new, [array(self.code, [t.id for t in tokenize(w.translate(spelled))]).tobytes() for w in new])
        return [memo.values_of[n] for n in numbers]

    def _learn_others(self, chunks):
        """Ids of any chunks: encoded together, cut where each begins."""
        for i in range(0, len(chunks), LEARN_CHUNKS):
            part = chunks[i : i + LEARN_CHUNKS]
            texts = [c.decode() for c in part]
            encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = array(self.code, encoding.ids).tobytes()
            starts = np.array([a for a, _ in encoding.offsets], np.int64)
            begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
            edges = (np.searchsorted(starts, begins) * self.dtype.itemsize).tolist()
            self.chunks.learn(part, [ids[a:b] for a, b in zip(edges, edges[1:])])

    def _learn(self, chunks):
        match = PLAIN.match
        plain, words, marks, others = [], [], [], []
        for chunk in chunks:
            found = match(chunk.decode())
            if found:
                plain.append(chunk)
                words.append(found[1].lower())
                marks.append(found[2])
            else:
                others.append(chunk)
        ends = {m: self._whole(m) if m else b"" for m in set(marks)}
        self.chunks.learn(plain, [ids + ends[m] for ids, m in zip(self._learn_words(words), marks)])
        self._learn_others(others)

    def encode(self, texts):
        """The ids of each text (as UTF-8) as little-endian bytes of self.dtype; null is empty."""
        if not self.splits:
            return [self._whole((t or b"").decode()) for t in texts]
        out, part, size, memo = [], [], 0, self.chunks
        for i, text in enumerate(texts, 1):
            # Bytes are cut at ASCII white space; what else is white space stays in a chunk.
            part.append(list(map(memo.__getitem__, (text or b"").split())))
            size += len(text or b"")
            if size > LEARN_BYTES or i == len(texts):
                new, memo.new = memo.new, []
                self._learn(new)
                ids = memo.values_of.__getitem__
                out += [b"".join(map(ids, numbers)) for numbers in part]
                part, size = [], 0
                memo.renew()
        return out


_ENCODERS = {}


def encoder(path):
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class PartWriter:
    """Writes one part under names of its own, so a retried task never meets an old file."""

    def __init__(self, root, length, dtype):
        self.files, base = fs.FileSystem.from_uri(root)
        self.files.create_dir(base, recursive=True)
        self.length = length
        self.dtype = dtype
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.ids_type = pa.list_(kind, length)
        self.mask_type = pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", self.ids_type), ("mask", self.mask_type)])
        self.docs_schema = pa.schema(
            [("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())]
        )
        name = f"{base}/{uuid.uuid4().hex}"
        self.paths = f"{name}.ids.arrow", f"{name}.docs.arrow"
        self.sinks = [self.files.open_output_stream(p) for p in self.paths]
        self.writers = [
            pa.ipc.new_file(s, t) for s, t in zip(self.sinks, (self.schema, self.docs_schema))
        ]
        self.pending, self.pending_bytes = [], 0
        self.n_tokens = 0

    def add(self, doc_ids, ids):
        """Documents in order: their ids as bytes, with the end id."""
        counts = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        first = self.n_tokens + np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.n_tokens += int(counts.sum())
        self.writers[1].write_batch(
            pa.record_batch(
                [doc_ids, pa.array(first), pa.array(counts)], schema=self.docs_schema
            )
        )
        for x in ids:
            self.pending.append(x)
            self.pending_bytes += len(x)
            if self.pending_bytes >= BATCH_ROWS * self.length * self.dtype.itemsize:
                self._flush(False)

    def _flush(self, last):
        tokens = np.frombuffer(b"".join(self.pending), self.dtype)
        whole = len(tokens) // self.length
        rest = tokens[whole * self.length :]
        for i in range(0, whole, BATCH_ROWS):
            n = min(BATCH_ROWS, whole - i)
            block = tokens[i * self.length : (i + n) * self.length]
            self._rows(block, np.ones(len(block), bool))
        if last and len(rest):
            mask = np.arange(self.length) < len(rest)
            self._rows(np.pad(rest, (0, self.length - len(rest))), mask)
            rest = rest[:0]
        self.pending, self.pending_bytes = [rest.tobytes()], rest.nbytes

    def _rows(self, tokens, mask):
        self.writers[0].write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(tokens), type=self.ids_type),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), type=self.mask_type),
                ],
                schema=self.schema,
            )
        )

    def close(self):
        self._flush(True)
        for x in (*self.writers, *self.sinks):
            x.close()
        return self.paths


def opened(root, path):
    """An Arrow file of a part; a memory map where the shared folder is a mounted one."""
    files, _ = fs.FileSystem.from_uri(root)
    if isinstance(files, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(files.open_input_file(path))


def write_tokens(docs, tokenizer_path, root, length=SEQUENCE, end_id=1):
    """Writes the Arrow files below root and returns their manifest.

    docs: doc_id, text; other columns are left out.  Rows go in ascending doc_id (null
    first, equal ones by text), one part for each range of them, each with its documents'
    tokens packed end to end in sequences of `length`; only a part's last is padded.  A
    null or empty text holds the end id alone; an empty table gives an empty manifest.

    Manifest: part, ids_path, docs_path, n_docs, n_tokens, start (tokens of earlier parts).
    A lost task writes new files; the manifest names those of the attempt that counted.
    """

    def write(batches):
        code = encoder(tokenizer_path)
        writer, n_docs = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                writer = PartWriter(root, length, code.dtype)
            end = np.array([end_id], code.dtype).tobytes()
            ids = [x + end for x in code.encode(batch.column("text").cast(pa.binary()).to_pylist())]
            writer.add(batch.column("doc_id"), ids)
            n_docs += batch.num_rows
        if writer is not None:
            ids_path, docs_path = writer.close()
            part = task_number()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()),
                    "ids_path": [ids_path],
                    "docs_path": [docs_path],
                    "n_docs": pa.array([n_docs], pa.int64()),
                    "n_tokens": pa.array([writer.n_tokens], pa.int64()),
                }
            )

    spark = docs.sparkSession
    with_key = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_tie"))
    ordered = with_key.repartitionByRange("doc_id", "_tie").sortWithinPartitions(
        "doc_id", "_tie", "text"
    )
    with small_batches(spark, 512):
        manifest = stored(
            ordered.drop("_tie").mapInArrow(
                write,
                "part long, ids_path string, docs_path string, n_docs long, n_tokens long",
            ),
            "manifest",
        )
    # One row for each file pair: few enough to order in one task.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn(
        "start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0).cast("long"))
    )


def task_number():
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_documents(manifest, root):
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    start counts the tokens of all documents before it; ids_crc32 is the crc32 of its ids as
    little-endian unsigned 32-bit integers.  A task reads one part batch by batch.
    """

    def read(tables):
        for table in tables:
            for part in table.to_pylist():
                ids = opened(root, part["ids_path"])
                docs = opened(root, part["docs_path"])
                batch, taken, left = -1, 0, np.empty(0)
                for b in range(docs.num_record_batches):
                    rows = docs.get_batch(b)
                    crcs = np.empty(rows.num_rows, np.int64)
                    for i, n in enumerate(rows.column("n_tokens").to_pylist()):
                        crc = 0
                        while n:
                            if taken == len(left):
                                batch, taken = batch + 1, 0
                                left = ids.get_batch(batch).column("ids").flatten().to_numpy()
                            here = left[taken : taken + n]
                            crc = zlib.crc32(here.astype("<u4").tobytes(), crc)
                            taken += len(here)
                            n -= len(here)
                        crcs[i] = crc
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("doc_id"),
                            pa.array(rows.column("first").to_numpy() + part["start"]),
                            rows.column("n_tokens"),
                            pa.array(crcs),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = manifest.select("part", "ids_path", "docs_path", "start")
    # A number given is kept: the rows are few and small, what they name is not.
    return parts.repartition(max(1, parts.count()), "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def read_sequence(root, ids_path, row):
    """Sequence `row` of a part and its mask, as views into the file."""
    file = opened(root, ids_path)
    for b in range(file.num_record_batches):
        batch = file.get_batch(b)
        if row < batch.num_rows:
            ids = batch.column("ids")
            mask = batch.column("mask").slice(row, 1).flatten()
            return ids.slice(row, 1).flatten().to_numpy(), mask
        row -= batch.num_rows
    raise IndexError("the part has fewer sequences")


def encoded(docs, tokenizer_path, length=SEQUENCE, end_id=1):
    """Encode, write to the shared folder and read back: a row per document."""
    root = new_folder(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, tokenizer_path, root, length, end_id), root)
