import hashlib
import json
import random
import re
from array import array
from zlib import crc32

import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sealmark.llm import bpe, chat, packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, ids string, piece string, spans string"  # columns that clash with the operators' own
TEXTS = ["", None, "a", "Hello, world's end!", "  two  spaces \n\n and\tmore ", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "naïve 中文字 １２３ ²³  x", "ab" * 3000, "word " * 5000, " " * 3000, "Hello, world's end!"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, "c", None, "s") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(bpe.default_vocabulary())


def random_texts(n=400, seed=2):
    rng = random.Random(seed)
    parts = ["a", " ", "\n", "1", "'s", "'LL", ",", " ", "é", "\t", "\x1c", "中", "the", " and", "<|endoftext|>", "<|", "😀", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encode_equals_the_library(lib):
    own = bpe.load(bpe.default_vocabulary())
    for t in [*random_texts(), *(x or "" for x in TEXTS)]:
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids, t
        assert own.decode_packed(own.encode_packed(t)) == lib.decode(ids, skip_special_tokens=False) == t


def test_merge_order_equals_naive_merging():
    own = bpe.load(bpe.default_vocabulary())

    def naive(text):
        s = [own.byte_ids[b] for b in text.encode()]
        while True:
            best = min(((own.merges[p][0], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in own.merges), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [own.merges[s[best[1]], s[best[1] + 1]][1]]

    rng = random.Random(4)
    for _ in range(300):
        w = "".join(rng.choice("aetionhs ") for _ in range(rng.randint(1, 25)))
        assert own.piece(w) == naive(w)


def test_a_full_memo_changes_nothing(lib, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    own = bpe.Bpe(bpe.default_vocabulary())
    for t in random_texts(100, 9) * 2:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids
    assert len(own.memo) <= 3 and len(own.units) <= 3


def test_frames_encode_decode_and_digest(spark, lib):
    df = frame(spark)
    coded = bpe.encode(df)
    assert {r.id: r.text for r in bpe.decode(coded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    got = {r.id: r for r in bpe.digests(df).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(frame(spark, [])).count() == 0


def test_packing_places_every_token_once(spark, lib):
    rng = random.Random(1)
    texts = [*TEXTS, *(" ".join(["tion"] * rng.randint(0, 1500)) for _ in range(60))]
    rows = packing.pack(frame(spark, texts)).collect()
    by_seq: dict[int, list] = {}
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum((r.ids for r in own), []) == ids
        at = 0
        for r in own:
            assert (r.start, r.length) == (at, len(r.ids)) and 0 < r.length <= 1024
            assert r.ids_crc32 == crc32(array("I", r.ids).tobytes())
            at += r.length
            by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(own) == 1 or all(r.length == 1024 for r in own[1:])
    for places in by_seq.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 1024
    assert packing.pack(frame(spark, [])).count() == 0


def test_best_fit_is_best_and_bounded():
    p = packing.Packer(10, 3)
    assert [p.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # free: 4, 3, 2
    assert p.place(3) == (1, 7)  # fits exactly, full at once
    assert p.place(2) == (2, 8)
    assert p.place(9) == (3, 0) and p.place(5) == (4, 0)  # free: 4, 1, 5
    assert p.place(6) == (5, 0)  # fits none: the bin with one free closes
    assert p.open == 3 and p.place(1)[1] == 6


def test_packing_is_near_the_bound():
    rng, p = random.Random(8), packing.Packer()
    sizes = [rng.choice([rng.randint(1, 1024), rng.randint(1, 200)]) for _ in range(20_000)]
    for n in sizes:
        p.place(n)
    assert p.made <= 1.01 * sum(sizes) / 1024 + 1


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"id": 1, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]}, "messages_parts", [("user", "qr")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\nx"), ("assistant", "y")]),
    ({"instruction": "do", "output": None}, "instruction", [("user", "do"), ("assistant", "")]),
    ({"system": "s", "prompt": "p", "completion": "c"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question", [("user", "c\nq"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"author": {"role": "user"}, "content": {"parts": ["q", "r"]}}, "author_parts", [("user", "qr")]),
    ({"prompt": "p"}, "prompt_only", [("user", "p")]),
    ({"completion": "c"}, "completion_only", [("assistant", "c")]),
    ({"who": "knows"}, None, []),
    ([1], None, []),
]


def test_fingerprints_choose_the_mapping(spark):
    known = chat.registry()
    for record, layout, turns in LAYOUTS:
        assert chat.turns_of(record, known)[1:] == (layout, turns)
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(99, "not json"), (98, None)]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"), keys=["conv_id"]).collect()
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        own = sorted((r for r in got if r.conv_id == i), key=lambda r: r.position or 0)
        assert [r.layout for r in own] == [layout] * max(1, len(turns))
        assert [(r.role, r.text) for r in own if r.position is not None] == turns
    assert {r.conv_id for r in got if r.layout is None} == {12, 13, 98, 99}


HOSTILE = ["", None, chat.HOSTILE, "<|", "<\\|", "<\\\\|x", "a<", "\\", "<|im_end|>\n", "<|im_start|>user\n", "line\nbreak", "😀" * 50, "x" * 50_000]


def test_template_is_reversible(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole\\n<|", None]), rng.choice(HOSTILE)) for c in [*range(20), None] for t in [0, 1, 1, None]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    segments = chat.render(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    whole = {r.conv_id: r.formatted for r in chat.assemble(segments).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (low(r[1]), low(r[2]) if r[2] is not None else (False, ""), (r[3] is not None, r[3] or "")))
        text = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own)
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(whole[c])
        assert whole[c].count("<|im_start|>") == whole[c].count("<|im_end|>") == len(own)


def test_a_stream_cut_anywhere_reads_the_same():
    """The reader sees no turns, only pieces; spans of the mask are of the whole stream."""
    rng = random.Random(16)
    escape = lambda t: re.sub(r"<(\\*)\|", lambda m: "<" + m[1] + "\\|", t)
    turns = [(rng.choice(["user", "assistant"]), (rng.choice(HOSTILE) or "") * rng.randint(1, 3)) for _ in range(60)]
    stream, masks = "", []
    for role, text in turns:
        stream += f"{chat.START}{role}\n"
        if role == "assistant":
            masks.append((len(stream), len(stream) + len(escape(text))))
        stream += escape(text) + chat.END + "\n"
    loss = "".join(t for role, t in turns if role == "assistant")
    want = (60, hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(stream))
    for size in (1, 7, 1000, 100_000, 10_000_000):
        reader, at, rest = chat.Reader(), 0, list(masks)
        while at < len(stream):
            step = rng.randint(1, size)
            begun = [m for m in rest if m[0] < at + step]
            reader.feed(stream[at : at + step], begun)
            at, rest = at + step, rest[len(begun) :]
        assert reader.close() == want
    with pytest.raises(ValueError):
        broken = chat.Reader()
        broken.feed(stream[:-3], [])
        broken.close()


def test_query_goes_through_many_layouts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(c, 0, r, "t") for c in range(30) for r in ("human", "gpt", None, "", "tool", "user")], rows.schema)
    back = chat.canonical_turns(chat.as_records(rows.unionByName(odd)), keys=["conv_id", "turn"])
    assert {r.layout for r in back.select("layout").distinct().collect()} == {"messages", "messages_parts", "conversations", "author_parts", "prompt_only", "completion_only", "turn"}
    empty = lambda df: sorted((r.conv_id, r.turn, r.role or "", r.text or "") for r in df.collect())
    assert empty(back) == empty(rows.unionByName(odd))


def test_query_has_the_hostile_conversation(spark):
    got = {r.conv_id: r for r in chat.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    want = hashlib.sha256(f"user\n{chat.HOSTILE}\nassistant\n{chat.HOSTILE}\n".encode()).hexdigest()
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars) == (2, want, len(chat.HOSTILE))


def test_query_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted(c.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({chat.OP3_SQL})").fetchall())
    assert sorted(tuple(r) for r in chat.op3_chat_format(spark, "/root/testdata/sf0.001").collect()) == want


def test_placement_equals_a_naive_best_fit():
    """Every open bin is looked at: the one with the least room that is enough, the latest of equals; the fullest closes where all are open."""
    rng = random.Random(11)
    for most, capacity in ((1, 10), (3, 20), (50, 64)):
        packer, bins, made = packing.Packer(capacity, most), [], 0  # (free, sequence), in the order in which they came to it
        for _ in range(2000):
            n = rng.randint(1, capacity)
            fits = [b for b in bins if b[0] >= n]
            if fits:
                free = min(b[0] for b in fits)
                at = [b for b in bins if b[0] == free][-1]
                bins.remove(at)
            else:
                at, made = (capacity, made), made + 1
                if n < capacity and len(bins) >= most:
                    fullest = min(b[0] for b in bins)
                    bins.remove([b for b in bins if b[0] == fullest][-1])
            assert packer.place(n) == (at[1], capacity - at[0])
            if at[0] > n:
                bins.append((at[0] - n, at[1]))
