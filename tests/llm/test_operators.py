"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import chat, simhash
from flowloom.llm.decontaminate import decontaminate
from flowloom.llm.hamming import sign_codes, top_k
from flowloom.llm.language import LanguageModel, held_out
from flowloom.llm.lines import dedup_lines
from flowloom.llm.packing import best_filling, fillings, lower_bound, pack, pieces, plan, tokens
from flowloom.llm.passages import dedup_passages
from flowloom.llm.pii import pseudonymise
from flowloom.llm.simhash import fingerprints, near_duplicates, similar_documents, tile_forest, xxh64_spans
from flowloom.llm.suffixes import dedup_suffixes, factors, rank_levels, repeated_starts

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.json")


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def docs(spark, texts, ids=None, extra=""):
    rows = [(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + (extra or "`part` string, `uid` int"))


LONG = " ".join(words(0, 40_000))
BASE = " ".join(words(1, 120))
TEXTS = [BASE, None, "", "  \n\t ", BASE, BASE + " tail", LONG, "a", "a b", " ".join(words(2, 30)) + " " + BASE + " " + " ".join(words(3, 30)), "ééé " * 300, "x" * 5000]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# --- SimHash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_of_spans_of_every_length():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts = np.arange(200)
    sizes = np.arange(200)
    assert xxh64_spans(data, starts, sizes).tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, sizes, strict=True)]


def test_near_duplicates(spark):
    got = by_id(near_duplicates(docs(spark, TEXTS)), "fp", "component_id")
    prints = [brute_print(t) for t in TEXTS]
    assert [got[i][0] % 2**64 for i in range(len(TEXTS))] == prints
    assert got[4][1] == got[0][1] == 0
    assert {got[i][1] for i in (1, 2, 3)} == {1}
    assert near_duplicates(docs(spark, TEXTS).limit(0)).count() == 0


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base ^ np.uint64(1 << int(rng.integers(63)) | 1 << int(rng.integers(63))) for _ in range(5)])
    x = np.unique(np.concatenate([base, near]))
    a, b = tile_forest(x[:, None], None, 3)
    names = list(range(len(x)))

    def find(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, j in zip(a, b, strict=True):
        assert bin(int(x[i] ^ x[j])).count("1") <= 3
        names[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(x)):
        for j in range(i):
            if bin(int(x[i] ^ x[j])).count("1") <= 3:
                assert find(i) == find(j)


def test_similar_documents_are_verified(spark):
    w = words(7, 200)
    near, far = w[:], w[:]
    near[50] = "other"
    far[::9] = ["other"] * len(far[::9])
    got = by_id(similar_documents(docs(spark, [" ".join(x) for x in (w, near, far)] + [None, ""])), "component_id")
    assert got == {0: (0,), 1: (0,), 2: (2,), 3: (3,), 4: (3,)}


def test_pairs_of_a_large_group_leave_it_only_if_similar():
    """Texts of one passage and some words of their own: of their 19,900 pairs those that can't be similar stay inside."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
    own = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in [60] * 198 + [1200, 10]]
    sets = [np.unique(np.concatenate([passage, x])) for x in own]
    sets[7] = np.unique(np.concatenate([sets[3][:-20], rng.integers(0, 1 << 63, 18, dtype=np.uint64)]))
    count = np.array([len(x) for x in sets])
    sketch = simhash.sketches(np.concatenate(sets), count)
    columns = [[1] * 200, range(200), range(200), count]
    batch = pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.int64()) for c in columns), sketch], names=["key", "part", "node", "size", "sketch"])
    # a group goes on over batches
    got = [(a, b) for out in simhash.group_pairs([batch.slice(0, 50), batch.slice(50)], 0.8) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)]
    similar = {(i, j) for i in range(200) for j in range(i + 1, 200) if len(both := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both))}
    assert similar and similar <= set(got)
    assert len(got) < 100


def test_sketches_bound_differences():
    """Of sets of every size: no pair that is similar is refuted, sketches of other widths too."""
    rng = np.random.default_rng(6)
    sets = []
    for n in (0, 1, 5, 63, 64, 65, 300, 511, 513, 3000, 20000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [one, one[: len(one) - len(one) // 9], np.unique(np.concatenate([one, rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)])), np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))]
    sketch = simhash.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert simhash.within(sketch, i, j, apart).all()
    unrelated = [(k, k + 3) for k in range(12, len(sets), 4)]
    sizes = np.array([len(sets[a]) for a, _ in unrelated])
    assert not simhash.within(sketch, *np.array(unrelated).T, sizes * 2 // 9).any()


def test_block_links_find_all_of_a_few_bits(spark, monkeypatch):
    """A bucket of very many is dealt into tiles; of 7 bits or fewer none is missed, and no edge is longer than the radius."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    near = base.copy()
    for row in near:
        for bit in rng.choice(128, 7, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    same = rng.integers(0, 1 << 63, (100, 2), dtype=np.uint64)
    same[:, 0] = same[:, 0] >> np.uint64(16) << np.uint64(16)
    x = np.concatenate([base, near, same]).view(np.int64)
    prints = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "node long, f0 long, f1 long")
    got = {(r["a"], r["b"]) for r in simhash.block_links(prints, 28, ["f0", "f1"]).collect()}
    assert {(i, i + 60) for i in range(60)} <= got
    far = lambda a, b: int(np.bitwise_count(x[a].view(np.uint64) ^ x[b].view(np.uint64)).sum())
    assert all(a < b and far(a, b) <= 28 for a, b in got)
    assert simhash.block_links(prints.limit(0), 28, ["f0", "f1"]).count() == 0


def brute_groups(texts, n=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    name = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= similarity * len(x | sets[j]) and name[i] != name[j]:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if k == old else k for k in name]
    return {i: (k,) for i, k in enumerate(name)}


def test_similar_documents_misses_none(spark):
    texts = []
    for seed in range(20):
        w = words(100 + seed, 100)
        texts += [" ".join(w), " ".join(w + ["ha"] * 80), " ".join(w + ["-", "|"] * 40)]
    for seed in range(150):
        w = words(200 + seed, 9)
        texts += [" ".join(w), " ".join(w[:8]), " ".join(w[:7])]
    for seed in range(60):
        w = words(400 + seed, 40)
        texts += [" ".join(w), " ".join([*w[:20], "new", *w[21:]]), " ".join(["new", *w[1:36]]), " ".join(w[3:])]
    texts += ["ha " * k for k in range(1, 12)] + [None, ""]
    got = by_id(similar_documents(docs(spark, texts)), "component_id")
    assert got == brute_groups(texts)


# --- lines


def test_lines(spark):
    line = "this is a line of more than twenty characters"
    texts = [f"{line}\nown line of the first one\n\nshort", f"{line}\n{line}x\n{line[:5]}X{line[6:]}\nshort\n", None, "", f"{line[:5]}XX{line[7:]}", "\n"]
    got = by_id(dedup_lines(docs(spark, texts), removed_col="gone"), "text", "gone", "part")
    assert got[0] == (texts[0], [], "x")
    assert got[1] == ("short\n", [0, 1, 2], "x")
    assert got[2] == (None, [], "x")
    assert got[3] == ("", [], "x")
    assert got[4][0] == ""  # one edit from an earlier line that is itself removed
    assert got[5] == ("\n", [], "x")
    assert by_id(dedup_lines(docs(spark, texts), max_edits=0), "text")[1] == (f"{line}x\n{line[:5]}X{line[6:]}\nshort\n",)
    assert dedup_lines(docs(spark, texts).limit(0)).count() == 0


# --- personal data


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    card, not_card = "4539 1488 0343 6467", "4539148803436468"
    texts = [f"card {card}, again 4539148803436467.", f"{not_card} 10.1.2.3 999.1.2.3", "born 2001-02-29 or 29.02.2004", None, "", "call +1 (212) 555-0199 or a.b-9@mail.example.com", "GB82WEST12345698765432 078-05-1120 666-05-1120"]
    got = by_id(pseudonymise(docs(spark, texts), "k"), "text", "n_replaced", "uid")
    new = re.findall(r"[0-9][0-9 ]{14,18}[0-9]", got[0][0])
    assert got[0][1] == 2
    assert new[0].replace(" ", "") == new[1] != card.replace(" ", "")
    assert luhn(new[0])
    assert got[1][0].startswith(not_card)
    assert got[1][0].endswith(" 999.1.2.3")
    assert got[1][1] == 1
    assert "2001-02-29" in got[2][0]
    assert re.search(r"or \d\d\.\d\d\.(19|20)\d\d$", got[2][0])
    assert got[3][:2] == (None, 0)
    assert got[4][:2] == ("", 0)
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or [a-z]\.[a-z]-\d@mail\.example\.com", got[5][0])
    iban = got[6][0].split()[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert got[6][0].endswith(" 666-05-1120")
    assert by_id(pseudonymise(docs(spark, texts), "k"), "text") == {i: v[:1] for i, v in got.items()}
    assert by_id(pseudonymise(docs(spark, texts), "other"), "text")[0] != got[0][:1]


def test_permutations_lose_no_value(spark):
    every = [f"10.0.{i // 256}.{i % 256}" for i in range(400)] + [f"2000-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    got = pseudonymise(docs(spark, every), "k").select("text").collect()
    assert len({r["text"] for r in got}) == len(every)


# --- decontamination


def test_decontaminate(spark):
    item = " ".join(words(11, 25))
    items = spark.createDataFrame([(1, item), (2, "ab cd"), (3, None), (3, ""), (None, item)], "item_id long, text string")
    texts = ["x " + " ".join(item.upper().split()[3:14]) + " y", "AB, cd!", None, "", " ".join(item.split()[:9]), "ab ab cd"]
    got = by_id(decontaminate(docs(spark, texts), items), "n_words", "n_hit", "items")
    assert got == {0: (13, 11, ["1", "null"]), 1: (2, 2, ["2"]), 2: (0, 0, []), 3: (0, 0, []), 4: (9, 0, []), 5: (3, 2, ["2"])}
    small = by_id(decontaminate(docs(spark, texts), items, block_bytes=1), "n_words", "n_hit", "items")
    assert small == got
    kept = decontaminate(docs(spark, texts), items, keep=True)
    assert kept.columns == ["doc_id", "text", "part", "uid", "contaminated"]
    assert decontaminate(docs(spark, texts), items.limit(0)).where("contaminated").count() == 0


# --- language


def test_language(spark):
    rng = np.random.default_rng(3)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "one" if i % 2 else "two") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", held_out("doc_id"))
    model = LanguageModel.fit(df.where("not held_out"), max_rows=100)
    got = model.predict(df.where("held_out")).collect()
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200))
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = by_id(model.predict(docs(spark, [None, "", "123 !", "É", "a"])), "lang_pred", "score")
    assert [odd[i][0] for i in range(3)] == ["und"] * 3
    assert odd[0][1] == 0
    none = LanguageModel.fit(df.limit(0))
    assert by_id(none.predict(docs(spark, ["abc"])), "lang_pred") == {0: ("und",)}
    assert model.predict(df.limit(0)).count() == 0


# --- packing


def test_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for text in ["", "Hello, world!", "  two  spaces \n\n x ", "naïve œuvre 日本語 👍🏽", "don't 12345 ###", "<|endoftext|>", "a" * 3000, "\t\r\n"]:
        assert tokens(text, PATH).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("length", [1, 5, 2048, 2049, 4096, 5000])
def test_pieces(length):
    got = pieces(length)
    assert sum(n for _, n in got) == length
    assert all(n == 2048 for _, n in got[1:])
    assert len(got) == -(-length // 2048)


def test_plan_uses_every_piece_and_comes_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 2049, 3000), minlength=2049)
    used, sequences = Counter(), 0
    for filling, times in plan(counts)[0]:
        assert sum(filling) <= 2048
        sequences += times
        for s in filling:
            used[s] += times
    assert all(used[s] == n for s, n in enumerate(counts))
    assert sequences <= 1.02 * -(-int((np.arange(2049) * counts).sum()) // 2048)


def fewest(pieces, capacity):
    """Fewest sequences, by trying every place for each piece."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, [*rooms[:r], rooms[r] - pieces[i], *rooms[r + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_plan_is_the_best_there_is_for_few_pieces():
    rng = np.random.default_rng(8)
    for _ in range(150):
        pieces = sorted((int(x) for x in rng.integers(3, 21, rng.integers(1, 11))), reverse=True)
        counts = np.bincount(pieces, minlength=21)
        out, proved = plan(counts, 20)
        assert sum(n for _, n in out) == fewest(pieces, 20) and proved
        assert sorted(s for f, n in out for s in f * n) == sorted(pieces)
        assert all(sum(f) <= 20 for f, _ in out)
        assert lower_bound(counts, 20) <= fewest(pieces, 20)


def test_filling_beats_best_fit():
    counts = np.zeros(11, int)
    counts[[6, 5]] = [1, 2]
    assert sorted(best_filling(10, counts)) == [5, 5]  # best fit takes 6 and wastes 4


def test_filling_may_pass_over_more_sizes_than_python_has_frames():
    counts = np.zeros(1029, int)
    counts[10:1021] = 1
    assert best_filling(1028, counts) == [1018, 10]  # best fit takes 1020 and finds no 8
    lengths = np.clip(np.exp(np.random.default_rng(1).normal(6, 1.3, 300_000)), 2, 2048).astype(int)
    out, proved = plan(np.bincount(lengths, minlength=2049))
    used = np.zeros(2049, int)
    for filling, times in out:
        assert sum(filling) <= 2048
        np.add.at(used, filling, times)
    assert (used == np.bincount(lengths, minlength=2049)).all() and proved


def test_fillings_are_all_there_are_in_order():
    rng = np.random.default_rng(3)
    for _ in range(60):
        room = int(rng.integers(0, 14))
        counts = rng.integers(0, 4, 15) * (np.arange(15) > 0)
        some = [f for n in range(room + 1) for f in itertools.combinations_with_replacement(range(14, 0, -1), n) if sum(f) <= room and all(f.count(s) <= counts[s] for s in f)]
        want = sorted(some, key=lambda f: (room - sum(f), [-s for s in f]))
        assert [tuple(f) for f in fillings(room, counts, room)] == want


def test_pack(spark):
    got = pack(docs(spark, [*TEXTS, *TEXTS]), PATH).collect()
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in placed.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
    for i, t in enumerate([*TEXTS, *TEXTS]):
        ids, own = tokens(t, PATH), sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert [(s, n) for _, s, n, _ in own] == pieces(len(ids))
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own)
    assert pack(docs(spark, TEXTS).limit(0), PATH).count() == 0


def test_added_tokens_as_the_library_does_by_default(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one<|endoftext|><|endoftext|>\n two ", "<|endoftext|", "é<|endoftext|>" * 1500, "plain"]
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4") for x in texts]
    assert 50256 in want[0]
    got = pack(docs(spark, texts), PATH).collect()
    for i, ids in enumerate(want):
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert [(s, n) for _, s, n, _ in own] == pieces(len(ids))
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own)


# --- passages and suffixes


def test_passages(spark):
    ids = [3, 1, None, 3, 9, 5, 2, 7, 8, 6, 10, 11]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    rank = [float("inf") if i is None else i for i in ids]
    first = {}
    for r, w in zip(rank, split, strict=True):
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            first[key] = min(first.get(key, r), r)
    want = Counter()
    for i, r, w in zip(ids, rank, split, strict=True):
        gone = {j for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < r for j in range(a, a + 13)}
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = dedup_passages(docs(spark, TEXTS, ids)).collect()
    assert Counter((r["doc_id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), r["kept_text"]) for r in got) == want
    assert dedup_passages(docs(spark, TEXTS).limit(0)).count() == 0


def test_factors():
    data = np.frombuffer(b"abcabcabxabcabd", np.uint8)
    levels = rank_levels(data, 28)
    order = np.lexsort((np.arange(len(data)), levels[-1][1]))
    suffixes = [data.tobytes()[i:] for i in range(len(data))]
    assert [suffixes[i] for i in order] == sorted(suffixes)
    text = b"0123456789" * 3 + b"xx"
    earlier, later = repeated_starts([text, b"90123456"], 7)
    starts = lambda i: text[i : i + 7]
    assert earlier[: len(text)].tolist() == [len(starts(i)) == 7 and any(starts(j) == starts(i) for j in range(i)) for i in range(len(text))]
    assert earlier[len(text) :].tolist() == [True, True] + [False] * 6
    assert later[0]


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffixes(spark, keep_first):
    texts = [*TEXTS, "ab" * 700, "q" + "ab" * 300, BASE[:399], BASE[:400]]
    raw = [(t or "").encode() for t in texts]
    places = {}
    for d, b in enumerate(raw):
        for a in range(len(b) - 399):
            places.setdefault(b[a : a + 400], []).append((d, a))
    got = by_id(dedup_suffixes(docs(spark, texts), keep_first=keep_first), "n_bytes", "spans", "kept")
    for d, b in enumerate(raw):
        gone = bytearray(len(b))
        for a in range(len(b) - 399):
            where = places[b[a : a + 400]]
            if len(where) > 1 and (not keep_first or where[0] != (d, a)):
                gone[a : a + 400] = b"\1" * 400
        assert got[d][0] == len(b)
        assert hashlib.sha256(bytes(got[d][2])).hexdigest() == hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), d
        assert len(got[d][1]) == len(re.findall(b"\1+", bytes(gone)))
    assert dedup_suffixes(docs(spark, TEXTS).limit(0)).count() == 0


def test_pairs_of_tiles_of_one_hash_are_sorted_apart(spark, monkeypatch):
    """A segment goes to several pairs of tiles, and must not be taken for a repeat of itself."""
    monkeypatch.setattr("flowloom.llm.suffixes.TILE", 2)
    shared, twice = " ".join(words(60, 50))[:300], " ".join(words(61, 60))[:200]
    texts = [" ".join(words(100 + i, 60)) + shared + (twice if i in (3, 20) else "") + f"{i} " + " ".join(words(200 + i, 60)) for i in range(24)]
    got = by_id(dedup_suffixes(docs(spark, texts), keep_first=False), "spans")
    gone = {i: [tuple(x) for x in s[0] or []] for i, s in got.items() if s[0]}
    at = {i: (texts[i].index(shared), texts[i].index(twice) + len(twice)) for i in (3, 20)}
    assert gone == {i: [at[i]] for i in at}


# --- search


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 64))
    x[50:90] = x[3]
    rows = [(i, [float(v) for v in x[i]]) for i in range(150)] + [(900, None), (901, []), (None, [1.0] * 64)]
    codes = sign_codes(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    assert codes.count() == 150
    got = {}
    for r in top_k(codes, codes.where("id in (0, 3, 60)"), 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["neighbor_id"]))
    b = x > 0
    for q in (0, 3, 60):
        want = sorted(((b[q] != b[i]).sum(), i) for i in range(150) if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]
    few = spark.createDataFrame([(1, 0), (2, 1)], "id long, code long")
    assert [tuple(r) for r in top_k(few, few.where("id = 1"), 7).collect()] == [(1, 1, 2, 1)]
    assert top_k(few.limit(0), few.limit(0)).count() == 0


def test_vectors_wider_than_a_code_are_an_error(spark):
    from pyspark.errors import PySparkException

    wide = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 65)], "id long, v array<double>")
    assert sign_codes(wide.where("id = 1"), "id", "v").count() == 1
    with pytest.raises(PySparkException, match="65 components"):
        sign_codes(wide, "id", "v").collect()


# --- chat


def test_layouts(spark):
    rows = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null}]}', "messages", [("user", "hi"), ("assistant", "")]),
        ('{"conversations":[{"from":"human","value":"q"},{"value":"a","from":"gpt"}]}', "from and value", [("user", "q"), ("assistant", "a")]),
        ('{"output":"o","instruction":"i","input":"x"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o","input":""}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"prompt":"p","completion":"c"}', "prompt and completion", [("user", "p"), ("assistant", "c")]),
        ('{"prompt":"p","response":"r","system":"s"}', "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ('{"question":7,"answer":true}', "question and answer", [("user", "7"), ("assistant", "true")]),
        ('{"messages":[]}', "messages", []),
        ('{"prompt":"p","other":1}', None, None),
        ("{broken", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id int, rec string")
    got = by_id(chat.canonical_turns(df, "rec"), "layout", "turns")
    for i, (_, layout, turns) in enumerate(rows):
        assert got[i][0] == layout, i
        assert (None if got[i][1] is None else [(t["role"], t["text"]) for t in got[i][1]]) == turns, i


def test_formatted_turns_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "", "~0~1<s>[user]", "日本 ~ [", "~~]]<<"]
    turns = [("user", texts[0]), ("assistant", texts[2]), ("we[i]rd~", texts[4]), ("assistant", texts[3]), ("assistant", texts[1])]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], "doc_id int, turns array<struct<role:string,text:string>>")
    done = chat.format_turns(df)
    back = by_id(done.select("doc_id", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text("formatted", "loss_spans").alias("m")), "t", "m")
    assert [tuple(t) for t in back[1][0]] == turns
    assert back[1][1] == texts[2] + texts[3] + texts[1]
    assert back[2] == ([], "")


def test_fingerprints_of_slices(spark):
    import pyarrow as pa

    whole = pa.array([BASE, None, "a b c d"])
    assert fingerprints(whole.slice(1, 2)).tolist() == [0, brute_print("a b c d")]


def test_keys_without_digits(spark):
    keys = ["AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "abcdefghij" * 3 + "ABCDEF", "gho_" + "Q" * 36, "abcdef" * 6 + "abcd"]
    texts = [f"the key {k} leaks" for k in keys] + ["no key here", "AKIA and ghp_ alone", "x" + "a" * 40]
    got = by_id(pseudonymise(docs(spark, texts), "k"), "text", "n_replaced")
    for i, k in enumerate(keys):
        assert k not in got[i][0] and got[i][1] == 1, k
        assert re.fullmatch(r"the key (AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36}|[0-9a-f]{40}) leaks", got[i][0])
    assert [got[i] for i in range(4, 7)] == [(t, 0) for t in texts[4:]]


# --- pseudonyms against the permutation in Python, and its inverse


def turn_half(part, other, key, tag, t, sign):
    seed = hashlib.sha256("|".join([key, tag, str(t), other]).encode()).hexdigest()
    digests = [hashlib.sha256(f"{seed}|{b}".encode()).hexdigest() for b in range(-(-len(part) // 16))]
    out = ""
    for i, c in enumerate(part):
        k = int(digests[i // 16][i % 16 * 4 : i % 16 * 4 + 4], 16) * sign
        first, n = (48, 10) if c in "0123456789" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (None, 1)
        out += c if first is None else chr(first + (ord(c) - first + k) % n)
    return out


def plain_feistel(value, key, tag, back=False):
    half = len(value) // 2
    left, right = value[:half], value[half:]
    for t in reversed(range(8)) if back else range(8):
        if t % 2 == 0:
            left = turn_half(left, right, key, tag, t, -1 if back else 1)
        else:
            right = turn_half(right, left, key, tag, t, -1 if back else 1)
    return left + right


def plain_pair(left, right, a, b, key, tag, back=False):
    prf = lambda t, x: int(hashlib.sha256("|".join([key, tag, str(t), str(x)]).encode()).hexdigest()[:15], 16)
    for t in reversed(range(8)) if back else range(8):
        if t % 2 == 0:
            left = (left + prf(t, right) * (-1 if back else 1)) % a
        else:
            right = (right + prf(t, left) * (-1 if back else 1)) % b
    return left, right


def test_pseudonyms_are_the_permutation_and_can_be_undone(spark):
    rng = np.random.default_rng(9)
    mails = ["".join(rng.choice(list("abcXYZ019._%+-"), n)) + "x@mail.example.com" for n in (1, 2, 5, 16, 17, 40, 79, 500)]
    ips = [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(30)]
    phones = [f"({a}) {b}-{c}" for a, b, c in zip(rng.integers(100, 999, 20), rng.integers(100, 999, 20), rng.integers(1000, 9999, 20))]
    texts = [*mails, *ips, *phones]
    done = by_id(pseudonymise(docs(spark, texts), "k"), "text")
    got = [done[i][0] for i in range(len(texts))]
    for old, new in zip(mails, got):
        own = old.split("@")[0]
        assert new == plain_feistel(own, "k", "email") + "@mail.example.com"
        assert plain_feistel(new.split("@")[0], "k", "email", back=True) == own
    for old, new in zip(ips, got[len(mails) :]):
        o, n = (list(map(int, x.split("."))) for x in (old, new))
        assert plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "k", "ipv4") == (n[0] * 256 + n[1], n[2] * 256 + n[3])
        assert plain_pair(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "k", "ipv4", back=True) == (o[0] * 256 + o[1], o[2] * 256 + o[3])
    for old, new in zip(phones, got[len(mails) + len(ips) :]):
        assert new == plain_feistel(old, "k", "phone")
        assert plain_feistel(new, "k", "phone", back=True) == old


def test_more_shapes_of_numbers(spark):
    ibans = ["GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
    texts = [f"pay {x} NEXT WEEK" for x in ibans] + ["amex 3782 822463 10005.", "GB83 WEST 1234 5698 7654 32", "no 3782 822463 10006"]
    got = by_id(pseudonymise(docs(spark, texts), "k"), "text", "n_replaced")
    for i, x in enumerate(ibans):
        new = re.fullmatch(r"pay ([A-Z0-9 ]+) NEXT WEEK", got[i][0])[1]
        assert [len(g) for g in new.split()] == [len(g) for g in x.split()] and new != x and got[i][1] == 1
        bare = new.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    new = re.fullmatch(r"amex (\d{4} \d{6} \d{5})\.", got[3][0])[1]
    assert luhn(new) and new != "3782 822463 10005"
    assert [got[i] for i in (4, 5)] == [(texts[i], 0) for i in (4, 5)]


# --- names, nulls, empty tables and long texts, for every operator that keeps columns

ODD = "`__uid` int, `__at` string, `whole` int, `Hit` int, `uid` string, `id` string, `gone` int, `lines` int"


def odd_docs(spark, texts):
    rows = [(i, t, 7, "at", 8, 9, "u", "i", 10, 11) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ODD)


@pytest.mark.parametrize("name", ["lines", "names", "items", "language", "turns", "formatted"])
def test_columns_come_back_unchanged(spark, name):
    same = "a line of more than twenty characters, twice"
    d = odd_docs(spark, [same, same, None, "", "mail a.b@example.com", "{}"])
    items = spark.createDataFrame([(1, "twenty characters")], "item_id long, text string")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")))
    got = {
        "lines": lambda: dedup_lines(d),
        "names": lambda: pseudonymise(d, "k"),
        "items": lambda: decontaminate(d, items, keep=True, block_bytes=1),
        "language": lambda: LanguageModel.fit(d.withColumn("lang", F.lit("x"))).predict(d),
        "turns": lambda: chat.canonical_turns(d, "text"),
        "formatted": lambda: chat.format_turns(d.withColumn("turns", turns)),
    }[name]()
    others = [c for c in d.columns if c not in ("doc_id", "text")]
    assert [c for c in got.columns if c in others] == others
    assert sorted(tuple(r) for r in got.select("doc_id", *others).collect()) == sorted(tuple(r) for r in d.select("doc_id", *others).collect())


def test_empty_tables_and_long_texts(spark):
    none = odd_docs(spark, ["x"]).limit(0)
    assert pseudonymise(none, "k").count() == 0
    assert sign_codes(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0
    long = "word " * 200_000
    d = docs(spark, [long + "a.b@example.com", long])
    assert by_id(pseudonymise(d, "k"), "n_replaced") == {0: (1,), 1: (0,)}
    item = spark.createDataFrame([(1, "word a b example com")], "item_id long, text string")
    assert by_id(decontaminate(d, item), "n_hit") == {0: (5,), 1: (0,)}
    model = LanguageModel.fit(d.withColumn("lang", F.lit("x")))
    assert by_id(model.predict(d), "lang_pred") == {0: ("x",), 1: ("x",)}


def test_language_model_is_multinomial_naive_bayes(spark):
    """Counts and posteriors against a plain dictionary of n-grams; 15 bits of hash seldom join two of so few."""
    train = [("one", "abc abd ab"), ("one", "Bca"), ("two", "xyz zzy b"), ("two", "xx é")]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string")
    model = LanguageModel.fit(df, orders=(1, 2), bits=15)
    grams = lambda t: [t[i : i + n] for n in (1, 2) for i in range(len(t) - n + 1)]
    counts = {x: Counter(g for y, t in train if y == x for g in grams(t.lower())) for x in ("one", "two")}

    def posterior(text):
        total = {}
        for x, c in counts.items():
            size = sum(c.values()) + 0.5 * (1 << 15)
            total[x] = np.log(sum(y == x for y, _ in train) / len(train)) + sum(np.log((c[g] + 0.5) / size) for g in grams(text.lower()))
        best = max(sorted(total), key=total.get)
        return best, 1 / sum(np.exp(v - total[best]) for v in total.values())

    tests = ["abc", "zyx", "b", "É", "ab xy", "abcabcxyzxyz"]
    got = by_id(model.predict(docs(spark, tests)), "lang_pred", "score")
    for i, t in enumerate(tests):
        best, score = posterior(t)
        assert got[i][0] == best
        assert abs(got[i][1] - score) < 1e-4


def test_wide_lines_and_repeated_rows(spark):
    line = "".join(np.random.default_rng(4).choice(list("abcdef gé😀"), 9000))
    texts = [line, line[:4000] + "X" + line[4000:], line[1:], line[:10] + "Y" + line[11:], line[:10] + "ZZ" + line[11:]]
    got = by_id(dedup_lines(docs(spark, texts), removed_col="gone"), "gone")
    # the fourth differs from the first by one replaced character, the last from the fourth by two edits and from the first by two
    assert got == {0: ([],), 1: ([0],), 2: ([0],), 3: ([0],), 4: ([],)}
    same = docs(spark, [line, line], ids=[None, None])
    assert [r["gone"] for r in dedup_lines(same, removed_col="gone").collect()] == [[], []]
