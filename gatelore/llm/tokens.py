"""Token ids of whole texts, inside tasks.

The tokenizers library encodes every distinct stretch of text; numpy finds the stretches and puts the answers together. A
byte-level vocabulary cuts a text into words before it encodes them, and some places are always cuts:

* a single blank between two signs that are not white space (the blank goes with what follows);
* a single line feed between such signs (it is a word of its own);
* between an ASCII letter and an ASCII sign that is neither letter nor white space.

So texts are cut there, and what lies between two cuts can be encoded by itself. Stretches of up to 24 bytes are looked up,
byte for byte, in a table of fixed size that a worker keeps; new ones go through the library, many joined in one call, and
are told apart again by the lengths of their tokens. Longer stretches (runs of blanks, scripts without blanks) always go
through the library, and so do texts that hold an added (special) token's content. All ways give the library's own ids,
which tests hold against an untouched tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gatelore.llm.common import kept_by_worker

#: Stretches that a worker remembers (32 bytes each) and their ids (4 bytes each).
SLOT_BITS, POOL_IDS = 19, 3 << 20
WORDS = 3
LONGEST = 8 * WORDS
#: Text bytes that are cut and looked up at once.
TILE = 512 << 10
#: New stretches that are joined for one call of the library.
JOINED = 512

LETTER, SIGN, WHITE = 1, 2, 4
#: What each byte is: ASCII letters, other printable ASCII signs, white space (and the controls that some take for it).
KINDS = np.zeros(256, np.uint8)
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[[*range(33, 65), *range(91, 97), *range(123, 127)]] = SIGN
KINDS[[*range(9, 14), *range(28, 33)]] = WHITE
#: Bytes that begin a sign which may be white space beyond ASCII.
MAYBE = np.zeros(256, bool)
MAYBE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
BARE, BLANK, LINE = 1, 2, 3


def _cuts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and kind of what comes before (nothing, a blank, a line feed) of each stretch. ``starts``: where texts begin, all of them not empty."""
    kind = KINDS[data]
    gap = (data == 32) | (data == 10)
    gap[0] = gap[-1] = False
    at = np.flatnonzero(gap)
    before, after = data[at - 1], data[at + 1]
    good = ((kind[at - 1] | kind[at + 1]) & WHITE == 0) & ~MAYBE[after]
    far = (before >= 128) & ((data[np.maximum(at - 2, 0)] == 0xC2) | MAYBE[data[np.maximum(at - 3, 0)]])
    edge = np.zeros(len(data) + 1, bool)  # a gap belongs to one text on both sides
    edge[starts] = True
    at = at[good & ~far & ~edge[at] & ~edge[at + 1]]
    inner = np.flatnonzero((kind[:-1] == LETTER) & (kind[1:] == SIGN)) + 1
    begin = np.concatenate([starts, at + 1, inner])
    order = np.argsort(begin, kind="stable")
    # a text may begin where two cuts seem to be
    begin = begin[order]
    first = np.concatenate([[True], begin[1:] != begin[:-1]])
    lead = np.concatenate([np.full(len(starts), BARE), np.where(data[at] == 32, BLANK, LINE), np.full(len(inner), BARE)])[order][first]
    begin = begin[first]
    end = np.append(begin[1:], len(data))
    end[:-1] -= lead[1:] != BARE
    return begin, end, lead.astype(np.uint64)


class Encoder:
    """The ids of texts, each text closed by ``end_id``."""

    def __init__(self, path: str, end_id: int = 0):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        plain = self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        self.known_cuts = plain and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: one sign stands for one byte
        for token, k in vocab.items():
            self.lengths[k] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.table = np.zeros((1 << SLOT_BITS, WORDS + 1), np.uint64)
        self.pool, self.used = np.zeros(POOL_IDS, np.uint32), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: list[bytes], leads: list[int]) -> list[np.ndarray]:
        """The ids of stretches with what comes before them, many in one call of the library."""
        out: list[np.ndarray] = [None] * len(parts)
        joined: list[tuple[list[int], bytes]] = []
        for lead, sign in ((BLANK, b" "), (BARE, b"\n")):
            mine = [k for k, x in enumerate(leads) if (x == BLANK) == (lead == BLANK) and not parts[k][:1].isspace() and not parts[k][-1:].isspace() and len(parts[k]) <= 4096]
            joined += [(some, sign) for some in (mine[i : i + JOINED] for i in range(0, len(mine), JOINED))]
        encoded = self._library([(sign + sign.join(parts[k] for k in some)).decode() for some, sign in joined])
        for (some, sign), ids in zip(joined, encoded):
            stops = np.cumsum(self.lengths[ids])
            ends = np.cumsum([len(parts[k]) + 1 for k in some])
            last = np.searchsorted(stops, ends)
            # a line feed is a token of its own and stays with LINE only; a blank is part of the first token
            if last[-1] >= len(ids) or (stops[last] != ends).any():
                continue
            firsts = np.append(0, last[:-1] + 1)
            for k, a, z in zip(some, firsts.tolist(), (last + 1).tolist()):
                out[k] = ids[a + (leads[k] == BARE) : z]
        rest = [k for k, x in enumerate(out) if x is None]
        signs = {BARE: b"", BLANK: b" ", LINE: b"\n"}
        for k, ids in zip(rest, self._library([(signs[int(leads[k])] + parts[k]).decode() for k in rest])):
            out[k] = ids
        return out

    def _tile(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie side by side in ``data``, and how many each text has."""
        begin, end, lead = _cuts(data, starts)
        size = end - begin
        padded = np.concatenate([data, np.zeros(LONGEST + 8, np.uint8)])
        view = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        tag = size.astype(np.uint64) << np.uint64(2) | lead
        key = np.empty((len(begin), WORDS), np.uint64)
        mix = tag * MIX
        for w in range(WORDS):
            key[:, w] = view[np.minimum(begin + 8 * w, len(view) - 1)] & MASKS[np.clip(size - 8 * w, 0, 8)]
            mix = (mix ^ (mix >> np.uint64(29)) ^ key[:, w]) * MIX
        slot = (mix >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        row = self.table[slot]
        short = size <= LONGEST
        hit = short & (row[:, WORDS] & np.uint64(0xFF) == tag)
        for w in range(WORDS):
            hit &= row[:, w] == key[:, w]
        count = (row[:, WORDS] >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
        place = (row[:, WORDS] >> np.uint64(16)).astype(np.int64)
        pools = [self.pool]
        missed = np.flatnonzero(~hit)
        if len(missed):
            of = missed[short[missed]]
            order = of[np.lexsort((tag[of], *key[of].T))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (tag[order[1:]] != tag[order[:-1]]) | (key[order[1:]] != key[order[:-1]]).any(axis=1)
            long = missed[~short[missed]]
            asked = np.concatenate([order[fresh], long])
            text = data.tobytes()
            ids = self._new([text[a:z] for a, z in zip(begin[asked].tolist(), end[asked].tolist())], lead[asked].tolist())
            n = np.array([len(x) for x in ids])
            where = np.cumsum(n) - n
            made = np.concatenate(ids)
            short_ids = int(n[: int(fresh.sum())].sum())
            # what this tile needs lies behind the pool; what later tiles may need is copied into it
            pools.append(made)
            index = np.cumsum(fresh) - 1
            count[order], place[order] = n[index], where[index] + len(self.pool)
            count[long], place[long] = n[fresh.sum() :], where[fresh.sum() :] + len(self.pool)
            kept = made[:short_ids]
            late = self.used + len(kept) > POOL_IDS
            if late:
                # the tile still reads the old pool
                self._clear()
            if len(kept) <= POOL_IDS:
                new = order[fresh]
                self.pool[self.used : self.used + len(kept)] = kept
                self.table[slot[new], :WORDS] = key[new]
                self.table[slot[new], WORDS] = (where[: len(new)] + self.used).astype(np.uint64) << np.uint64(16) | n[: len(new)].astype(np.uint64) << np.uint64(8) | tag[new]
                self.used += len(kept)
        total = int(count.sum())
        source = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(total)
        if len(pools) == 1:
            out = pools[0][source]
        else:
            out, behind = pools[0][np.minimum(source, POOL_IDS - 1)], source >= POOL_IDS
            out[behind] = pools[1][source[behind] - POOL_IDS]
        text_of = np.searchsorted(begin, starts)
        return out, np.add.reduceat(count, text_of)

    def _long(self, text: bytes) -> np.ndarray:
        """One text in tiles that end at a blank between ASCII letters."""
        out, at, lead = [], 0, b""
        while at < len(text):
            end = len(text)
            if end - at > TILE:
                k = at + TILE
                while (k := text.rfind(b" ", at + 1, k)) > 0 and not (text[k - 1 : k].isalpha() and text[k + 1 : k + 2].isalpha()):
                    pass
                end = k if k > 0 else end
            part = np.frombuffer(text, np.uint8, end - at, at)
            if lead:  # the blank before this tile belongs to its first word
                part = np.concatenate([np.frombuffer(b"a ", np.uint8), part])
            ids, _ = self._tile(part, np.zeros(1, np.int64))
            out.append(ids[1:] if lead else ids)
            at, lead = end + 1, b" "
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """In slices of texts: the first text's number, the ids of them all side by side, and where each text's ids end.

        Null is an empty text; every text is closed by the end id.
        """
        texts = texts.cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        special = np.zeros(len(texts), bool)
        for content in self.added:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        bounds = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        sizes, first = np.diff(bounds), 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + TILE, "right")) - 1)
            whole = special[first:last] | ~np.bool_(self.known_cuts)
            if last == first + 1 and sizes[first] > TILE and not whole[0]:
                ids = self._long(data[bounds[first] : bounds[last]].tobytes())
                counts = np.array([len(ids)])
            elif whole.any():
                some = self._library([t.as_py() for t in texts[first:last]])
                ids, counts = np.concatenate(some), np.array([len(x) for x in some])
            else:
                counts = np.zeros(last - first, np.int64)
                filled = np.flatnonzero(sizes[first:last])
                ids = np.zeros(0, np.uint32)
                if len(filled):
                    ids, counts[filled] = self._tile(data[bounds[first] : bounds[last]], bounds[first:last][filled] - bounds[first])
            ends = np.cumsum(counts + 1)
            out = np.full(int(ends[-1]), self.end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            yield first, out, ends
            first = last


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    return kept_by_worker(f"encoder of {path}", lambda: Encoder(path))


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
