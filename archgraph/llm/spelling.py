"""Spelling variants by a search scheme over FM-indexes of the vocabulary.

Words are counted over all texts. Two words that differ by one edit agree in
one half: the edit lies in the front half of a word or in its back half. So a
word is searched twice, once with its back half matched exactly and extended to
the left across the front half, once with its front half matched exactly and
extended to the right; one error is allowed in the extension. A match is an
interval of suffix ranks in an index over the words laid end to end between
delimiters: the index of the words for extensions to the left, and the index of
the reversed words for extensions to the right, where right is left.

The vocabulary is dealt by the half that a match must share: a word is posted
under the halves that words of its own length, one less or one more would
match, and asks under its own. A task indexes the postings that came to it, in
whole halves and chunks of bounded size. A half shared by more than
``BLOCK_ROWS`` words is split into blocks which all of its askers visit, so no
task holds more than its block whatever the half is. A pair that shares both
halves is counted from the front half only, so partial results add up and only
one row per word, direction and block is shuffled.

Null and empty texts have no words. A null id counts as an empty one in the
deletions' checksums. Repeated rows count again. Further columns are not read.
Among near words of equal count the smallest in code-point order is the form.
Forms rise in count, so following them ends.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.grouped import dealt, whole_groups
from archgraph.llm.sized import scoped_batches
from archgraph.llm.text import LOWER, byte_table, hash_spans, ragged, row_offsets, spans, text_slices
from archgraph.session import materialize

LEAST_LENGTH, LEAST_COUNT = 5, 3
FORM_FACTOR = 2
DELETED_ONE_IN = 97  # fixed value of the deletions' rule
BLOCK_ROWS = 1 << 17
ASKED_AT_ONCE = 1 << 13
HELD_WORDS = 1 << 19
LONG_RUN = 64  # bytes; longer runs take their checksum one by one

# Letters of runs: A to Z, a to z, and C3 with the byte after it (U+00C0 to U+00FF); that byte is marked.
_LEAD, _MARK = 0xC3, 0x01
_LETTER = byte_table((ord("a"), ord("z")), (_LEAD, _LEAD), (_MARK, _MARK))


def _checksum_table():
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


_CHECKSUM = _checksum_table()


def checksums(begun, data, start, end):
    """CRC-32 of the bytes of spans, each begun with the checksum of what stands before it."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    state = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    first = start[order]
    falling = -length[order]
    short = int(np.searchsorted(falling, -LONG_RUN))
    for i in range(short):
        at = order[i]
        state[i] = zlib.crc32(data[start[at] : end[at]].tobytes(), int(begun[at])) ^ 0xFFFFFFFF
    for step in range(min(LONG_RUN, int(length.max(initial=0)))):
        live = int(np.searchsorted(falling, -step))
        own = state[short:live]
        state[short:live] = _CHECKSUM[(own ^ data[first[short:live] + step]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def words_of(data, offsets, ids):
    """Words of rows after the deletions, of at least ``LEAST_LENGTH`` code points, and their numbers: a table ``word``, ``n``."""
    low = LOWER[data]
    marked = np.where(low == _MARK, np.uint8(0), low)
    marked[np.flatnonzero(low[:-1] == _LEAD) + 1] = _MARK
    start, end, row = spans(marked, offsets, _LETTER)
    leads = np.concatenate(([0], np.cumsum(low == _LEAD)))
    length = end - start - (leads[end] - leads[start])
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
    sums = checksums(begun[row], low, start, end)
    changed = (sums % DELETED_ONE_IN == 0) & (length > LEAST_LENGTH)
    whole = np.flatnonzero((sums % DELETED_ONE_IN != 0) & (length >= LEAST_LENGTH))
    _, where, number = np.unique(hash_spans(low, start[whole], end[whole]), return_index=True, return_counts=True)
    where = whole[where]
    size = (end - start)[where]
    stops = row_offsets(size).astype(np.int32)
    blob = low[ragged(start[where], size)]
    plain = pa.Array.from_buffers(pa.string(), len(where), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(blob.tobytes())])
    shortened = []
    for i in np.flatnonzero(changed).tolist():
        run = low[start[i] : end[i]].tobytes().decode()
        at = int(sums[i]) % len(run)
        shortened.append(run[:at] + run[at + 1 :])
    words = pa.concat_arrays([plain, pa.array(shortened, pa.string())])
    return pa.table({"word": words, "n": np.append(number, np.ones(len(shortened), dtype=np.int64))})


def vocabulary(docs, id_column="doc_id", text="text", least=LEAST_COUNT):
    """Written rows ``word``, ``n`` of all words with at least ``least`` occurrences; counts are added up in tasks first."""
    rows = docs.select(F.col(f"`{id_column}`").alias("found_id"), F.col(f"`{text}`").alias("found_text"))

    def count(batches):
        held, rows = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in text_slices(batch.column(1)):
                held.append(words_of(data, offsets, ids[first : first + len(offsets) - 1]))
                rows += len(held[-1])
                if rows > HELD_WORDS:
                    held = [_added(held)]
                    rows = len(held[0])
                    if rows > HELD_WORDS // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from _added(held).to_batches()

    with scoped_batches(docs.sparkSession):
        added = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return materialize(added.where(F.col("n") >= least), "vocabulary")


def _added(tables):
    """One row per word; string buffers are cut to what the words need."""
    table = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": table["word"], "n": table["n_sum"]}).combine_chunks()


def postings(words):
    """``word, n`` by the halves to share: ``direction`` (1: reversed), ``place`` of the half, ``asks``, ``turned`` (the word as indexed)."""
    length = F.char_length("word")
    turned = F.reverse("word")

    def rows(direction, value, shortest, own):
        return [
            F.struct(
                F.lit(direction).alias("direction"), F.xxhash64(F.lit(direction), F.right(value, half)).alias("place"),
                (half == own).alias("asks"), value.alias("turned"))
            for half in (shortest, shortest + 1)
        ]

    def halved(column):
        return F.floor(column / 2).cast("int")

    both = rows(0, F.col("word"), halved(length), halved(length + 1)) + rows(1, turned, halved(length - 1), halved(length))
    return words.select("n", F.explode(F.array(*both)).alias("posting")).select("n", "posting.*")


def blocked(posted, block_rows=BLOCK_ROWS):
    """Postings with their ``block``: words of a half with more than ``block_rows`` are dealt over blocks, and ask in all of them."""
    sizes = materialize(
        posted.groupBy("direction", "place").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_rows)
        .select("direction", "place", F.ceil(F.col("size") / block_rows).cast("int").alias("blocks")), "large-halves")
    if sizes.isEmpty():
        return posted.withColumn("block", F.lit(0)).withColumn("indexed", F.lit(True))
    placed = posted.join(sizes, ["direction", "place"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("turned"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt_out = placed.withColumn("own_block", own).withColumn("block", F.explode(F.when(F.col("asks"), everywhere).otherwise(F.array("own_block"))))
    return dealt_out.withColumn("indexed", F.col("block") == F.col("own_block")).drop("blocks", "own_block")


class Strings:
    """Words of Latin-1 characters, one code each, laid end to end."""

    def __init__(self, column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        lead = data == _LEAD
        codes = data.copy()
        codes[np.flatnonzero(lead) + 1] += 0x40
        before = np.concatenate(([0], np.cumsum(lead)))
        self.codes = codes[~lead]
        self.begin = (ends - ends[0]) - before[ends - ends[0]]
        self.length = np.diff(self.begin)


class Index:
    """FM-index of distinct words between delimiters: intervals of suffix ranks, extended to the left.

    Suffixes are ordered up to the next delimiter, then by place, which is all
    that a search inside of words needs.
    """

    def __init__(self, strings, chosen):
        length = strings.length[chosen]
        self.text = np.zeros(int(length.sum()) + len(chosen) + 1, dtype=np.uint8)
        self.word_begin = row_offsets(length + 1)[:-1] + 1
        self.text[ragged(self.word_begin, length)] = strings.codes[ragged(strings.begin[:-1][chosen], length)]
        self.size = len(self.text)
        order = self._order()
        self.before = self.text[order - 1]
        self.keys = np.sort(self.before.astype(np.int64) * self.size + np.arange(self.size))
        at_begin = order[self.before == 0]
        self.begins_at = np.searchsorted(self.word_begin, at_begin)  # word whose begin has a rank, in the order of ranks
        self.delimiters = len(chosen) + 1
        self.alphabet = np.flatnonzero(np.bincount(self.text, minlength=256)[1:]) + 1

    def _order(self):
        stops = np.flatnonzero(self.text == 0)
        left = stops[np.searchsorted(stops, np.arange(self.size))] - np.arange(self.size)
        padded = np.append(self.text, np.zeros(8, dtype=np.uint8))
        key = np.zeros(self.size, dtype=np.uint64)
        for step in range(8):
            key = (key << np.uint64(8)) | np.where(left > step, padded[step : step + self.size], 0).astype(np.uint64)
        known, longest = 8, int(left.max())
        while longest > known:
            rank = np.unique(key, return_inverse=True)[1]
            after = np.where(left > known, rank[np.minimum(np.arange(self.size) + known, self.size - 1)], 0)
            key = rank.astype(np.uint64) * np.uint64(self.size) + after.astype(np.uint64)
            known *= 2
        return np.argsort(key, kind="stable")

    def extend(self, code, rank):
        """Where the interval bound ``rank`` moves when the match is extended to the left by ``code``."""
        return np.searchsorted(self.keys, code.astype(np.int64) * self.size + rank)

    def children(self, low, high):
        """(state, code) for every letter that stands left of a match."""
        size = high - low
        small = np.flatnonzero(size <= len(self.alphabet))
        row = ragged(low[small], size[small])
        pairs = np.repeat(small, size[small]) * 256 + self.before[row]
        large = np.flatnonzero(size > len(self.alphabet))
        tried = np.repeat(large, len(self.alphabet)) * 256 + np.tile(self.alphabet, len(large))
        pairs = np.concatenate((np.unique(pairs), tried))
        code = pairs & 255
        return pairs[code > 0] >> 8, code[code > 0]

    def words_at(self, low, high):
        """The word, if any, that begins where each match begins: its number, or -1."""
        first = self.extend(np.zeros(len(low), dtype=np.int64), low)
        last = self.extend(np.zeros(len(low), dtype=np.int64), high)
        return np.where(last > first, self.begins_at[np.minimum(first, len(self.begins_at) - 1)], -1)

    def one_error(self, strings, asked, exact):
        """Pairs (place in ``asked``, word of the index) that differ by one edit and agree in the last ``exact`` letters."""
        begin, at = strings.begin[asked], strings.length[asked].copy()
        codes = strings.codes
        low, high = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), self.delimiters)
        for step in range(int(exact.max(initial=0))):
            live = np.flatnonzero((exact > step) & (high > low))
            code = codes[begin[live] + at[live] - 1 - step]
            low[live], high[live] = self.extend(code, low[live]), self.extend(code, high[live])
        who = np.flatnonzero(high > low)
        at, low, high = (at - exact)[who], low[who], high[who]
        wrong = []
        while len(who):
            want = np.where(at > 0, codes[np.maximum(begin[who] + at - 1, 0)], 0)
            follows = np.where(at > 1, codes[np.maximum(begin[who] + at - 2, 0)], 0)
            # Of equal letters in a row the first is left out; an inserted letter stands before none like it.
            gone = np.flatnonzero((at > 0) & (want != follows))
            wrong.append((who[gone], at[gone] - 1, low[gone], high[gone]))
            state, code = self.children(low, high)
            next_low, next_high = self.extend(code, low[state]), self.extend(code, high[state])
            some = next_high > next_low
            state, code, next_low, next_high = state[some], code[some], next_low[some], next_high[some]
            right = code == want[state]
            wrong.append((who[state[~right]], at[state[~right]], next_low[~right], next_high[~right]))
            other = ~right & (at[state] > 0)
            wrong.append((who[state[other]], at[state[other]] - 1, next_low[other], next_high[other]))
            who, at, low, high = who[state[right]], at[state[right]] - 1, next_low[right], next_high[right]
        return self._finished(codes, begin, *(np.concatenate([w[i] for w in wrong]) if wrong else np.zeros(0, dtype=np.int64) for i in range(4)))

    def _finished(self, codes, begin, who, at, low, high):
        """Matches without a further error to the beginnings of words."""
        ones, others = [], []
        while len(who):
            done = at == 0
            word = self.words_at(low[done], high[done])
            ones.append(who[done][word >= 0])
            others.append(word[word >= 0])
            who, at, low, high = who[~done], at[~done], low[~done], high[~done]
            code = codes[begin[who] + at - 1]
            low, high = self.extend(code, low), self.extend(code, high)
            some = high > low
            who, at, low, high = who[some], at[some] - 1, low[some], high[some]
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *ones]), np.concatenate([empty, *others])


def near_words(direction, turned, counts, group, asks, indexed):
    """Partial results of the words that ask in a chunk: a table ``word, n, n_near, best_n, best_word``.

    ``group`` numbers the (half, block) of every row; a match counts only where
    both words have a row in the same one.
    """
    distinct, first, back = np.unique(np.array(turned.to_pylist(), dtype=object), return_index=True, return_inverse=True)
    posted = np.flatnonzero(indexed)
    in_index = np.zeros(len(distinct), dtype=bool)
    in_index[back[posted]] = True
    chosen = np.flatnonzero(in_index)
    strings = Strings(pa.array(distinct.tolist(), pa.string()))
    groups = np.full((2, len(distinct)), -1, dtype=np.int64)  # a word is posted under two halves of a direction
    groups[0, back[posted]] = group[posted]
    other = posted[groups[0, back[posted]] != group[posted]]
    groups[1, back[other]] = group[other]
    asking = np.flatnonzero(asks)
    asked = back[asking]
    length = strings.length[asked]
    exact = length // 2 if direction else (length + 1) // 2
    ones, others = [], []
    if len(chosen):
        index = Index(strings, chosen)
        for begin in range(0, len(asking), ASKED_AT_ONCE):
            own = slice(begin, begin + ASKED_AT_ONCE)
            one, word = index.one_error(strings, asked[own], exact[own])
            ones.append(one + begin)
            others.append(chosen[word])
    empty = np.zeros(0, dtype=np.int64)
    one, word = np.concatenate([empty, *ones]), np.concatenate([empty, *others])
    together = (groups[:, word] == group[asking[one]]).any(axis=0)
    if not direction:
        together &= ~_same_front(strings, asked[one], word)
    one, word = one[together], word[together]
    straight = [w[::-1] if direction else w for w in distinct.tolist()]
    place = np.empty(len(distinct), dtype=np.int64)
    place[sorted(range(len(straight)), key=straight.__getitem__)] = np.arange(len(straight))
    number = counts[first]
    order = np.lexsort((place[word], -number[word], one))
    one, word = one[order], word[order]
    best = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else empty
    best_word = np.full(len(asking), -1)
    best_word[one[best]] = word[best]
    none = best_word < 0
    names = pa.array(straight, pa.string())
    return pa.table({
        "word": names.take(pa.array(asked)), "n": number[asked], "n_near": np.bincount(one, minlength=len(asking)).astype(np.int64),
        "best_n": pa.array(number[best_word], mask=none), "best_word": names.take(pa.array(best_word, mask=none)),
    })


def _same_front(strings, asked, word):
    """Whether the front half of the asking word also begins the other."""
    front = strings.length[asked] // 2
    same = strings.length[word] >= front
    for step in range(int(front.max(initial=0))):
        live = np.flatnonzero(same & (front > step))
        same[live] = strings.codes[strings.begin[asked[live]] + step] == strings.codes[strings.begin[word[live]] + step]
    return same


_KEYS = ["direction", "place", "block"]
_PARTIAL = "word string, n long, n_near long, best_n long, best_word string"


def near_counts(words, block_rows=BLOCK_ROWS):
    """``word, n, n_near`` and the near word of largest count, for every row of the vocabulary ``words``."""
    rows = blocked(postings(words), block_rows).select(*_KEYS, "asks", "indexed", "turned", "n")

    def search(batches):
        for table, begins in whole_groups(batches, _KEYS):
            group = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            sides = table.column("direction").to_numpy()
            for direction in (0, 1):
                own = np.flatnonzero(sides == direction)
                if not len(own):
                    continue
                part = table.take(pa.array(own))
                found = near_words(
                    direction, part.column("turned"), part.column("n").to_numpy(), group[own],
                    part.column("asks").to_numpy(), part.column("indexed").to_numpy())
                yield from found.cast(pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best_word", pa.string())])).combine_chunks().to_batches()

    partial = dealt(rows, _KEYS).mapInArrow(search, _PARTIAL)
    best = F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best_word").alias("word")))
    return partial.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))


def spelling_variants(docs, id_column="doc_id", text="text", least=LEAST_COUNT, factor=FORM_FACTOR, block_rows=BLOCK_ROWS):
    """Words with their ``form`` (the near word of largest count, if ``factor`` times as frequent), ``root``, ``n``, ``n_near``, ``form_n``."""
    words = vocabulary(docs, id_column, text, least)
    near = near_counts(words, block_rows)
    good = -F.col("best.less") >= factor * F.col("n")
    formed = materialize(
        near.select("word", "n", "n_near", F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "word-forms")
    rooted = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms):
    """``word, root`` of all words with a form: each round doubles the way followed, so a few rounds reach the last form."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next_root"))
        doubled = reached.join(further, "root", "left").select("word", F.coalesce("next_root", "root").alias("root"), F.col("next_root").isNotNull().alias("moved"))
        doubled = materialize(doubled, "roots")
        reached = doubled.select("word", "root")
        if doubled.where("moved").isEmpty():
            return reached
