"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

Encoding. A token sequence is the BPE encoding of its bytes exactly when each two neighbours, merged on their own,
give themselves back; every byte string has exactly one such sequence. So a nondeterministic transducer reads bytes
while it walks the trie of tokens, and may end a token wherever the token's pair with the token before it is stable.
It is determinised as it is used (subset construction): a state is the ordered set of open hypotheses, each (last token,
trie node) in one integer. A transition names, for every hypothesis it leaves, the one it came from, and the token that ends there, so
outputs needn't be part of the states. Every ``LOOK`` bytes the hypotheses are followed back to where they agree, and the
tokens up to there are emitted: a hypothesis dies when its trie path ends, so the lookahead is bounded by the longest token.
States and transitions (an integer each) are built on first use and kept by the worker, up to ``MAX_STATES``, then started anew.

Whether a pair is stable is read off two spines: the parts at the right edge of the left token and at the left edge of
the right one, each with the rank at which it is swallowed. If a merge across the boundary comes before both parts
are swallowed (on a tie the merge further left goes first), the pair isn't stable.

Text is split by the tokenizer's pattern first; a match that is itself a token is that token. The matches of a batch are
dictionary-encoded, so each distinct one is looked up once a batch; ids of recent ones are kept as packed bytes. Decoding keeps at most
three pending bytes and emits characters as they complete; malformed bytes give U+FFFD per maximal part.

Defined cases: null and empty texts encode to no ids and decode to the empty text. Texts of any length are encoded
whole: a match of any length costs one step per byte. Repeated rows are encoded each. Other columns are passed through
untouched; results are in new columns whose names the caller may choose.
"""
from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_STATES = 200_000
MAX_WORDS = 300_000
LOOK = 4096
WORD_CHARS = 48  # longer matches aren't kept for reuse
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: per line a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """Plain BPE, quadratic: repeatedly merge the leftmost pair of lowest rank under ``below``. For table building."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tables(ranks: dict[bytes, int]) -> dict:
    """What workers need, as plain values: tokens by id, and each token's left and right part (None: a byte, or a token
    that merges can't reach and that only stands for a whole match)."""
    tokens = {r: t for t, r in ranks.items()}
    parts = {}
    for rank, token in tokens.items():
        if len(token) > 1:
            p = merge_bytes(token, ranks, rank)
            if len(p) == 2:
                parts[rank] = (ranks[p[0]], ranks[p[1]])
    return {"ranks": ranks, "parts": parts}


class Transducer:
    """Bytes of one match in, token ids out. Nodes of the trie and states are numbers; ``go`` and ``moves`` are keyed
    by 256 * number + byte. In a state, hypotheses stand in the order of the bytes where their open token began; the last
    is the one whose token has just ended. A hypothesis is (last token + 1) << NODE | trie node, a move
    state << 44 | number of its origins << 22 | ended token. A trie node without children is left out once its token was tried."""

    NODE, MASK = 22, (1 << 22) - 1

    def __init__(self, table: dict):
        self.ranks, self.parts = table["ranks"], table["parts"]
        self.token = {r: t for t, r in self.ranks.items()}
        self.go: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]
        for token, rank in self.ranks.items():
            if len(token) > 1 and rank not in self.parts:
                continue
            node = 0
            for b in token:
                self.inner[node] = True
                nxt = self.go.get(node << 8 | b)
                if nxt is None:
                    nxt = self.go[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = nxt
            self.ends[node] = rank
        if max(len(self.ends), *self.token) > self.MASK - 1:
            raise ValueError("the vocabulary is too large for the packed states")
        self.stable: dict[int, bool] = {}
        self.origins, self.origin_ids = [], {}  # few distinct ones: kept for good
        self.restart((0,))
        self.begin = 0

    def restart(self, state: tuple) -> int:
        """Forget all states but ``state`` and the first one."""
        first = (0,)
        self.sets, self.ids, self.moves = [first], {first: 0}, {}
        if len(self.stable) > 2 * MAX_STATES:
            self.stable.clear()
        return self.number(state)

    def number(self, state: tuple) -> int:
        to = self.ids.get(state)
        if to is None:
            to = self.ids[state] = len(self.sets)
            self.sets.append(state)
        return to

    def spine(self, token: int, side: int) -> list[int]:
        out = [token]
        while (p := self.parts.get(token)) is not None:
            token = p[side]
            out.append(token)
        return out

    def is_stable(self, a: int, b: int) -> bool:
        left, right = self.spine(a, 1), self.spine(b, 0)
        i, j, known = len(left) - 1, len(right) - 1, True
        while True:
            up_left = left[i - 1] if i else NEVER  # a token's id is the rank of the merge that makes it
            up_right = right[j - 1] if j else NEVER
            merge = self.ranks.get(self.token[left[i]] + self.token[right[j]], NEVER)
            if merge < up_left and merge <= up_right:
                known = False
                break
            if not i and not j:
                break
            if up_left <= up_right:
                i -= 1
            else:
                j -= 1
        self.stable[a << 32 | b] = known
        return known

    def step(self, state: int, byte: int) -> int:
        go, ends, inner, stable, mask = self.go, self.ends, self.inner, self.stable, self.MASK
        moved, origins, ended, token = [], [], 0, -1
        for i, hypothesis in enumerate(self.sets[state], -len(self.sets[state])):  # counted from the end: -1 has just ended a token
            node = go.get((hypothesis & mask) << 8 | byte)
            if node is None:
                continue
            if ended == 0 and ends[node] >= 0:
                before = (hypothesis >> self.NODE) - 1
                ok = before < 0 or stable.get(before << 32 | ends[node])
                if ok is None:
                    ok = self.is_stable(before, ends[node])
                if ok:
                    ended, token = i, ends[node]
            if inner[node]:
                moved.append(hypothesis & ~mask | node)
                origins.append(i)
        if ended == 0:
            raise ValueError("the ranks don't cover every byte")
        moved.append(token + 1 << self.NODE)
        key = (*origins, ended)
        at = self.origin_ids.get(key)
        if at is None:
            at = self.origin_ids[key] = len(self.origins)
            self.origins.append(key)
        move = self.moves[state << 8 | byte] = self.number(tuple(moved)) << 44 | at << 22 | token
        return move

    def backwards(self, history: list[int], hypothesis: int) -> list[int]:
        """The tokens that end on the way to a hypothesis of the last state, in order."""
        out, origins, mask = [], self.origins, self.MASK
        for move in reversed(history):
            if hypothesis == -1:
                out.append(move & mask)
            hypothesis = origins[move >> 22 & mask][hypothesis]
        out.reverse()
        return out

    def agreed(self, history: list[int]) -> tuple[int, int]:
        """(position, hypothesis) up to which all hypotheses of the last state have one history; position 0 if none."""
        alive = set(range(-len(self.origins[history[-1] >> 22 & self.MASK]), 0))
        for at in range(len(history), 0, -1):
            if len(alive) == 1:
                return at, alive.pop()
            origins = self.origins[history[at - 1] >> 22 & self.MASK]
            alive = {origins[h] for h in alive}
        return 0, 0

    def encode(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        state, find, out, history, settle = self.begin, self.moves.get, [], [], LOOK
        for part in (match,) if len(match) <= LOOK else [match[i:i + LOOK] for i in range(0, len(match), LOOK)]:
            for b in part:
                move = find(state << 8 | b)
                if move is None:
                    if len(self.sets) > MAX_STATES:  # start the tables anew around the state at hand
                        state = self.restart(self.sets[state])
                        find = self.moves.get
                    move = self.step(state, b)
                history.append(move)
                state = move >> 44
            if len(history) > settle:
                at, hypothesis = self.agreed(history)
                out += self.backwards(history[:at], hypothesis)
                history = history[at:]
                settle = LOOK + 2 * len(history)
        return out + self.backwards(history, -1)


class Utf8Stream:
    """Incremental UTF-8 decoder: ``push`` token bytes, get the characters they complete. Moves are kept by
    (pending bytes, token)."""

    #: fixed by the encoding: for each range of first bytes, the ranges of the bytes that must follow
    FOLLOW = [((0x00, 0x7F), []), ((0xC2, 0xDF), [(0x80, 0xBF)]),
              ((0xE0, 0xE0), [(0xA0, 0xBF), (0x80, 0xBF)]), ((0xE1, 0xEC), [(0x80, 0xBF)] * 2), ((0xED, 0xED), [(0x80, 0x9F), (0x80, 0xBF)]),
              ((0xEE, 0xEF), [(0x80, 0xBF)] * 2), ((0xF0, 0xF0), [(0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)]),
              ((0xF1, 0xF3), [(0x80, 0xBF)] * 3), ((0xF4, 0xF4), [(0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)])]

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.follow = {b: rest for (lo, hi), rest in self.FOLLOW for b in range(lo, hi + 1)}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    def push(self, pending: bytes, more: bytes) -> tuple[str, bytes]:
        out, part = [], b""
        for b in pending + more:
            c = bytes([b])
            if part:
                lo, hi = self.follow[part[0]][len(part) - 1]
                if lo <= b <= hi:
                    part += c
                    if len(part) == 1 + len(self.follow[part[0]]):
                        out.append(part.decode("utf-8"))
                        part = b""
                    continue
                out.append("�")
                part = b""
            if b not in self.follow:
                out.append("�")
            elif self.follow[b]:
                part = c
            else:
                out.append(chr(b))
        return "".join(out), part

    def decode(self, ids: Iterable[int]) -> str:
        out, pending, moves, token = [], b"", self.moves, self.token
        for i in ids:
            known = moves.get(pending)
            if known is None:
                known = moves[pending] = {}
            move = known.get(i)
            if move is None:
                move = known[i] = self.push(pending, token[i])
            out.append(move[0])
            pending = move[1]
        return "".join(out) + ("�" if pending else "")


def letter_classes(pattern: str) -> tuple[str, str]:
    """(fast, exact): the pattern as the installed ``regex`` library reads it, and with its classes spelled out as the
    reference tokenizer library defines them (Unicode versions differ). Both agree on texts below U+0530."""
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for name in (r"\p{L}", r"\p{N}"):
        asked = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={})
        points = [ord(c) for c in bytes(asked.encode_ordinary(everything)).decode("utf-8")]
        cuts = np.flatnonzero(np.diff(points) != 1)
        starts, ends = [points[0], *(points[i + 1] for i in cuts)], [*(points[i] for i in cuts), points[-1]]
        spelled = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))
        pattern = pattern.replace(f"[^\\s{name}", f"[^\\s{spelled}").replace(f"{name}]", f"{spelled}]").replace(name, f"[{spelled}]")
    return pattern, pattern


def codec(table: dict) -> dict:
    """The worker's transducer, decoder and caches, built once per worker and kept with the broadcast value."""
    kept = table.get("kept")
    if kept is None:
        import regex

        transducer = Transducer(table)
        kept = table["kept"] = {
            "fast": regex.compile(table["fast"]), "exact": regex.compile(table["exact"]), "rare": regex.compile("[԰-\U0010ffff]"),
            "transducer": transducer, "decoder": Utf8Stream(transducer.token), "words": {}, "old": {}}
    return kept


def word_ids(kept: dict, words: list[str]) -> list[bytes]:
    """The packed ids of each word, from the worker's recent ones or the transducer."""
    recent, old, encode, out = kept["words"], kept["old"], kept["transducer"].encode, []
    for w in words:
        ids = recent.get(w)
        if ids is None:
            ids = old.get(w)
            if ids is None:
                ids = array("i", encode(w.encode("utf-8"))).tobytes()
            if len(w) <= WORD_CHARS:
                if len(recent) >= MAX_WORDS:  # the older half of the kept words goes, unless used again
                    old = kept["old"] = recent
                    recent = kept["words"] = {}
                recent[w] = ids
        out.append(ids)
    return out


def encode_texts(kept: dict, texts: list[str | None]) -> pa.ListArray:
    """The ids of every text."""
    words, counts = [], [0]
    for t in texts:
        t = t or ""
        found = (kept["exact"] if kept["rare"].search(t) else kept["fast"]).findall(t)
        words += found
        counts.append(len(found))
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    del words
    packed = word_ids(kept, coded.dictionary.to_pylist())
    offsets = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
    taken = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))).take(coded.indices)
    return pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[np.cumsum(counts)].astype(np.int32)), taken.values)


def encode_text(kept: dict, text: str) -> list[int]:
    return encode_texts(kept, [text])[0].as_py()


def share(spark: SparkSession, ranks_path: str, pattern: str):
    """Broadcast of the tokenizer's tables: their size is the vocabulary's."""
    exact = letter_classes(pattern)[1]
    return spark.sparkContext.broadcast({**tables(read_ranks(ranks_path)), "fast": pattern, "exact": exact})


def with_columns(schema: T.StructType, new: list[T.StructField]) -> T.StructType:
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + new)


def map_texts(df: DataFrame, new: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]], rows: int = 256) -> DataFrame:
    """Arrow map that keeps the other columns and appends ``new``, in small batches."""
    schema = with_columns(df.schema, new)
    kept_names = [f.name for f in schema.fields[:-len(new)]]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in kept_names] + make(part), names=names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the array<int> column ``ids_col``."""
    shared = share(df.sparkSession, ranks_path, pattern)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        kept = codec(shared.value)
        return [encode_texts(kept, part.column(part.schema.get_field_index(text_col)).to_pylist())]

    return map_texts(df, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the string column ``text_col`` decoded from ``ids_col`` (null ids: empty)."""
    shared = share(df.sparkSession, ranks_path, pattern)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        decoder = codec(shared.value)["decoder"]
        return [pa.array([decoder.decode(x or ()) for x in part.column(part.schema.get_field_index(ids_col)).to_pylist()], pa.string())]

    return map_texts(df, [T.StructField(text_col, T.StringType())], make)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Encode, then decode the ids, in one pass over the rows. The text itself isn't carried on."""
    shared = share(df.sparkSession, ranks_path, pattern)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        kept = codec(shared.value)
        ids = encode_texts(kept, part.column(part.schema.get_field_index(text_col)).to_pylist())
        flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
        return [ids, pa.array([kept["decoder"].decode(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:])], pa.string())]

    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    out = map_texts(df, new, make)
    return out.drop(text_col) if text_col not in (ids_col, decoded_col) else out
