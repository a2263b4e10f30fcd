"""Prefix trie and structure repair against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from conftest import SMALL

from daygrid.llm import cyk_repair, prefix_trie, q_conversations
from daygrid.llm.radix_tree import Node, Tree

SCHEMA = "conv_id long, turn long, role string, text string, id string, words string, place string, part int, node string, h int, base string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * 7 for r in rows], SCHEMA)


def messy_conversations():
    same = [(c, t, r, x) for c in range(100, 140) for t, r, x in ((0, "user", "Hello there."), (1, "assistant", "Yes, what is it?"))]
    long = [(7, t, ("user", "assistant")[t % 2], f"turn {t % 5}. " + "x y " * (3000 if t == 9 else 1)) for t in range(700)]
    return [*same, *long, (None, 0, "user", "No id."), (None, None, None, None), (3, None, None, None), (3, None, "user", ""), (4, 1, "user", " \t"),
            (4, 1, "assistant", "Tie."), (4, 1, "assistant", "Tie."), (5, 0, "", "Nobody."), (-5, 0, "system", "Be kind."), (-5, 1, "user", "é\U0001f600 so"),
            (9, 5, "tool", "{}"), (9, 2, "user", "Go!"), (10, 0, "user", "...")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", turn_id(r or "", x or ""), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += children[node] == 0
        saved[node] += (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        if node:
            children[node[:-1]] += 1
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), children[n], leaves[n], saved[n],
                   digest(",".join(map(str, sorted(c for c in m if len(full[c]) == len(n)))))) for n, m in members.items())


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def test_layouts_grow():
    node = Node(b"", 0)
    bytes_put = random.Random(1).sample(range(256), 256)
    for k, byte in enumerate(bytes_put):
        node.put(byte, Node(bytes([byte]), k))
        assert node.layout == (4 if k < 4 else 16 if k < 16 else 48 if k < 48 else 256)
        assert [c.path[0] for c in node.children()] == sorted(bytes_put[:k + 1])
    assert all(node.child(b).path == bytes([b]) for b in bytes_put)


def test_tree_holds_every_key():
    draw = random.Random(2)
    keys = sorted(bytes(draw.choices(range(3) if draw.random() < 0.7 else range(256), k=draw.randrange(9))) for _ in range(3000))
    tree = Tree()
    for key in keys:
        tree.insert(key)
    out, todo = [], [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        path = above + node.path
        assert [k for k in keys if k.startswith(path)] == keys[node.first:node.last + 1]
        assert node.ends or len(node.children()) > 1 or node is tree.root
        out += [path] * node.ends
        for byte in range(256):
            below = node.child(byte)
            if below is not None:
                todo.append((below, path + bytes([byte])))
    assert sorted(out) == keys


@pytest.mark.parametrize("run", [1, 2, 7, prefix_trie.RUN])
def test_trie_of_messy_rows(spark, run):
    rows = messy_conversations()
    got = prefix_trie.trie(q_conversations.rebuilt(table(spark, rows).repartition(3)), run)
    assert found(got) == plain_trie(rows)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_nothing(spark):
    assert found(prefix_trie.trie(q_conversations.rebuilt(table(spark, [(None, 1, "user", "x")])))) == []
    assert found(prefix_trie.trie(q_conversations.rebuilt(table(spark, [])))) == []


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(q_conversations.shared_beginnings(spark, SMALL)) == plain_trie(rows)


def test_trie_of_common_beginnings(spark):
    draw = random.Random(3)
    rows = [(c, t, "user", f"say {draw.randrange(2)}") for c in range(300) for t in range(draw.randrange(1, 7))]
    assert found(prefix_trie.trie(q_conversations.rebuilt(table(spark, rows)), 11)) == plain_trie(rows)


# ---- structure repair ----

LEGAL = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def all_cuts(kinds):
    """The whole chart: every span, every cut."""
    n, chart = len(kinds), {}
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            cell = cyk_repair._row(kinds[i]) if length == 1 else None
            for cut in range(i + 1, i + length):
                cut_cell = cyk_repair._join(chart[i, cut], chart[cut, i + length])
                cell = cut_cell if cell is None else [[min((x for x in (a, b) if x is not None), default=None) for a, b in zip(x, y)] for x, y in zip(cell, cut_cell)]
            chart[i, i + length] = cell
    return min(c for c in (chart[0, n][0][q] for q in (0, 3)) if c is not None)


def by_search(kinds):
    """Least (cost, audit) by trying edits in order of cost, then of audits."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(kinds) and state in (0, 3):
            return cost, audit
        if (at, state, cost, audit) in seen or len(audit) > 2 * len(kinds) + 2:
            continue
        seen.add((at, state, cost, audit))
        for role in "ua":
            if state in LEGAL[role]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, LEGAL[role][state]))
        if at < len(kinds):
            kind, more = kinds[at].lower(), int(kinds[at].isupper())
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state))
            if kind != "x":
                for role in "sua":
                    if state in LEGAL[role] and (role == kind or role != "s"):
                        heapq.heappush(heap, (cost + more + 2 * (role != kind), audit + ("K" if role == kind else "R"), at + 1, LEGAL[role][state]))
    raise AssertionError


def test_parse_against_search():
    for n in range(4):
        for kinds in itertools.product("suaoSUAOx", repeat=n):
            kinds = "".join(kinds)
            assert cyk_repair.parse(kinds) == by_search(kinds), kinds
    draw = random.Random(4)
    for _ in range(60):
        kinds = "".join(draw.choices("suaoUAx", k=draw.randrange(4, 9)))
        assert cyk_repair.parse(kinds) == by_search(kinds), kinds


def test_parse_against_the_whole_chart():
    draw = random.Random(5)
    for n in (5, 16, 17, 33, 50):
        kinds = "".join(draw.choices("suaoSUAx", weights=(1, 8, 8, 1, 1, 2, 2, 2), k=n))
        assert cyk_repair.parse(kinds) == all_cuts(kinds)
    cost, audit = cyk_repair.parse("ua" * 20_000 + "x")
    assert (cost, audit) == (3, "K" * 40_000 + "D")


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else v for v in (c, t, r, x))
        kind = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repairs(rows):
    groups = {c: [] for c, *_ in rows}
    for c, t, r, x in plain_damage(rows):
        groups[c].append((t is not None, t or 0, r, turn_id(r, x), x))
    out = []
    for c, v in groups.items():
        seen, kinds, count, illegal, lines = set(), "", [0, 0, 0], 0, []
        v = [(t if known else None, r, x) for known, t, r, _, x in sorted(v)]
        for k, (_, r, x) in enumerate(v):
            ends = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = 0 if not ends else 1 if (r, x) in seen else 2 if ends[-1] not in ".!?" else None
            seen.add((r, x))
            kind = r[:1] if r[:1] in ("s", "u", "a") else "o"
            kinds += kind if fault is None else kind.upper() if fault == 2 else "x"
            if fault is not None:
                count[fault] += 1
            illegal += k > 0 and v[k - 1][1][:1] + r[:1] not in ("su", "ua", "au")
        known = [t for t, _, _ in v if t is not None]
        cost, audit = cyk_repair.parse(kinds)
        state, left = 0, list(v)
        for edit in audit:
            _, role, text = left.pop(0) if edit != "I" else (None, None, "")
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if state == 2 else "user"
            state = LEGAL[role[0]][state]
            lines.append(f"{role}:{text}")
        assert state in (0, 3) and not left
        out.append((c if c is not None else -10**9, max(known) - min(known) + 1 - len(set(known)) if known else 0, *count, illegal, cost, audit, digest("\n".join(lines))))
    return sorted(out)


def repairs_of(spark, rows):
    df = table(spark, rows).repartition(3)
    damaged = q_conversations.damaged(df)
    told = cyk_repair.summary(damaged, df.select("conv_id"))
    hashes = {r.of: r.repaired_sha256 for r in cyk_repair.line_hashes(cyk_repair.repaired(damaged, told)).collect()}
    return sorted((-10**9 if r.conv_id is None else r.conv_id, *r[1:], hashes.get(r.conv_id, digest(""))) for r in told.collect())


def test_repairs_of_messy_rows(spark):
    rows = messy_conversations()
    assert repairs_of(spark, rows) == plain_repairs(rows)
    assert repairs_of(spark, []) == []
    dropped = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped and repairs_of(spark, dropped) == [(c, 0, 0, 0, 0, 0, 0, "", digest("")) for c, *_ in dropped]


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = q_conversations.repairs(spark, SMALL)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert sorted(tuple(r) for r in got.collect()) == plain_repairs(rows)


def test_repaired_rows(spark):
    df = table(spark, [(1, 0, "assistant", "Well."), (1, 1, "tool", "{}"), (1, None, "system", "Be kind."), (1, 5, "user", "Why?")])
    told = cyk_repair.summary(df)
    assert [tuple(r) for r in told.collect()] == [(1, 3, 0, 0, 1, 3, *by_search("saOu"))]
    lines = [tuple(r) for r in cyk_repair.repaired(df, told).collect()]
    assert [x[1] for x in lines] == list(range(1, len(lines) + 1)) and re.fullmatch("s?(ua)+", "".join(x[3][0] for x in lines))
