"""Fill-in-the-middle documents: cut at units (runs of letters, single other characters) that are found in words of eight bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, arrow_type, kept_names, table, utf8, with_columns

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents, so many are transformed, and of 100 of those, so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of whole texts whose words are marked at once; a longer text is marked by itself.
AT_ONCE = 16 << 20
CUT = "n_units long, form string, prefix_bytes long, middle_bytes long, prefix_chars long, middle_chars long, output string"
#: A byte of a word, in every byte of it.
EACH, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Words (uint64) whose bytes' high bits mark the bytes of valid UTF-8 (uint8, padded to whole words) that end a unit.

    A byte ends one unless the next continues its character, or both are letters. The last byte looks at a zero.
    """
    x = data.view(np.uint64)
    low = (x & ~HIGH) | (EACH * np.uint64(0x20))  # seven bits a byte, upper case as lower: sums below don't carry into the next byte
    letter = (low + EACH * np.uint64(0x80 - ord("a"))) & ~(low + EACH * np.uint64(0x80 - ord("z") - 1)) & ~x & HIGH
    inner = x & ~(x << np.uint64(1)) & HIGH  # 10xxxxxx continues a character
    return ~(_next(inner) | (letter & _next(letter))) & HIGH


def _next(marks: np.ndarray) -> np.ndarray:
    """For each byte, the mark of the byte after it (words are little-endian)."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def select(ends: np.ndarray, upto: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions after the k-th marked bytes (k from 1), given the marks and their cumulative counts by word; any for a k without a mark."""
    word = np.minimum(np.searchsorted(upto, k), len(ends) - 1)
    rest = (k - np.where(word > 0, upto[word - 1], 0)).astype(np.uint64)
    within = ((ends[word] >> np.uint64(7)) * EACH)[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(8)) & np.uint64(0xFF)  # byte i: marks in bytes 0 to i
    return word * 8 + (within < rest[:, None]).sum(axis=1) + 1


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units n of each text, and the bytes before two cuts in it: after draws % (n + 1) units each, the smaller first.

    Text i holds the bytes offsets[i] to offsets[i + 1] of data (both from 0, UTF-8).
    """
    size = int(offsets[-1])
    padded = np.zeros(-(-size // 8) * 8 + 8, dtype=np.uint8)
    padded[:size] = data[:size]
    ends = unit_ends(padded)
    marks = ends.view(np.uint8)
    marks[size:] = 0
    marks[offsets[1:][np.diff(offsets) > 0] - 1] = 0x80  # a text's end ends a unit, whatever the next text begins with
    upto = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
    inside = np.bitwise_count(ends[offsets // 8] & ((np.uint64(1) << (offsets % 8 * 8).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    before = np.where(offsets >= 8, upto[np.maximum(offsets // 8, 1) - 1], 0) + inside
    n = np.diff(before)
    at = np.sort(draws.astype(np.int64) % (n[:, None] + 1), axis=1)
    bytes_at = [np.where(a > 0, select(ends, upto, np.maximum(before[:-1] + a, 1)), offsets[:-1]) - offsets[:-1] for a in at.T]
    return n, bytes_at[0], bytes_at[1]


def restored(output: bytes | None, form: str) -> bytes | None:
    """The text that an output was made from. A mark ends in `>` and begins with `<`, so none is found before its place."""
    if output is None or form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, at_once: int = AT_ONCE) -> DataFrame:
    """docs plus n_units, form (plain, psm or spm), the bytes and characters of prefix and middle (null if plain), and the output.

    Units are runs of A-Z and a-z, and single other characters. What becomes of a document follows from its id and the
    seed alone: four unsigned numbers of 32 bits, from the hash of both, choose the two cuts, whether it is transformed, and
    whether the suffix comes first. An empty text, or one that holds a mark, stays plain. A null text stays null and plain; a null id
    draws as an empty one. Repeated rows give equal outputs. Texts may be of any length (a task holds a batch of them and `at_once`
    bytes of marks, or the marks of one longer text). Empty table: empty result. Columns named like new ones are replaced.
    """
    kept, schema = kept_names(docs, CUT), arrow_type(CUT)

    def each(batches):
        for batch in batches:
            texts, names = utf8(batch, text_col), batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            draws = np.array([_draws(f"{seed}:{'' if i is None else i}") for i in names], dtype=np.uint32).reshape(-1, 4)
            for some in _parts(texts, at_once):
                own = texts[some]
                offsets = np.cumsum([0, *(len(t or b"") for t in own)], dtype=np.int64)
                n, a, b = cuts(np.frombuffer(b"".join(t or b"" for t in own), dtype=np.uint8), offsets, draws[some, :2])
                rows = [_formed(*row, transformed, suffix_first) for row in zip(own, n.tolist(), a.tolist(), b.tolist(), draws[some, 2].tolist(), draws[some, 3].tolist(), strict=True)]
                columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(schema)
                yield with_columns(batch.slice(some.start, some.stop - some.start), kept, schema, columns[:-1] + [pa.array(columns[-1], type=pa.binary()).cast(pa.string())])

    return arrow_map(docs, CUT, each)


def _draws(text: str) -> list[int]:
    return np.frombuffer(hashlib.sha256(text.encode()).digest()[:16], dtype=">u4").tolist()


def _parts(texts: list[bytes | None], most: int) -> list[slice]:
    """Runs of whole texts of up to so many bytes, one text at least."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or b"") > most:
            out.append(slice(begin, i))
            begin, size = i, 0
        size += len(t or b"")
    return [*out, slice(begin, len(texts))] if texts else []


def _formed(text: bytes | None, n: int, a: int, b: int, whether: int, which: int, transformed: int, suffix_first: int) -> tuple:
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or whether % 100 >= transformed:
        return n, "plain", None, None, None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if which % 100 < suffix_first:
        form, out = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, a, b - a, len(prefix.decode()), len(middle.decode()), out


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output, and of the text rebuilt from it."""
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    digests = "output_sha256 string, restored_sha256 string"
    names, schema = ["doc_id", "n", "form", "prefix_chars", "middle_chars"], arrow_type(digests)

    def each(batches):
        for batch in batches:
            forms, outputs = batch.column(batch.schema.get_field_index("form")).to_pylist(), utf8(batch, "output")
            yield with_columns(batch, names, schema, [[hashlib.sha256(o).hexdigest() for o in outputs], [hashlib.sha256(restored(o, f)).hexdigest() for o, f in zip(outputs, forms, strict=True)]])

    return arrow_map(cut.withColumnRenamed("n_units", "n").select(*names, "output"), digests, each, keep=names)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us FROM documents),
k AS (
  SELECT doc_id, text, us, CAST(len(us) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT doc_id, text, us, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (
  SELECT doc_id, text, n, form, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
