from __future__ import annotations

import hashlib
import math

import pytest

from orrery.llm import chat as C
from orrery.llm import secrets as S

from .helpers import clashing, empty, hard_rows, words

KEY = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"
FOUND = [
    (f'token = "{KEY}"', "token", KEY), (f"see {KEY[:4]} api_key: '{KEY}' ok", "api_key", KEY), ("password: hunter2x9", "password", "hunter2x9"), ('a = "s3cr3tX9"\nb = a\ndb_password = b', "db_password", "s3cr3tX9"),
    ('BASE = "abc123def"\nAPI_KEY = BASE + "987xyz6543210zzq"', "API_KEY", "abc123def987xyz6543210zzq"), ("cfg['secret_key'] = 'k3jh4k5jh34k5jh3'", "secret_key", "k3jh4k5jh34k5jh3"), ('password: str = "Tr0ub4dor"', "password", "Tr0ub4dor"),
    ('{"name": "DB_PASSWORD", "value": "p4ssw0rd!x"}', "DB_PASSWORD", "p4ssw0rd!x"), ("<password>h4xx0rz99</password>", "password", "h4xx0rz99"), ("postgres://bob:s3cretPw1@host/db", "url.password", "s3cretPw1"), ("run --token 9f8e7d6c5b4a39281706", "token", "9f8e7d6c5b4a39281706"),
    ('define("DB_PASSWORD", "zz91kfj2");', "DB_PASSWORD", "zz91kfj2"), ("PASSWORD=${DB_PW}\nDB_PW=qwe98rty7", "PASSWORD", "qwe98rty7"), ('x = f"{p}-1"\np = "abc12389xx"\npassword = x', "password", "abc12389xx-1"), ("$pass_phrase = 'a';\n$dbPassword = \"zX91kk\" . 'q7';", "dbPassword", "zX91kkq7"),
]
CLEAN = [
    "", 'password = "changeme"', 'password = os.environ["X"]', "the key: important thing", "tokens: 500", 'if password == "x1234567": pass', f'public_key = "{KEY}"', "client_secret = a\na = b\nb = a", 'title = "The secret of the old house"', "password = None", "Token: a word in prose", 'secret = "xxxxxxxxxxxxxxxx"',
    'password_hint = "my first car"', "http://example.com:8080/key=1",
]


def test_names_in_parts_and_short_flags_are_read(spark):
    """The test before the lexer lets every name pass that the scorer joins from its parts."""
    texts = ['DB_PASS_PHRASE = "zX91kkq7"', 'pass.code: "h4xx0rz99"', 'PASS_WORD = "Tr0ub4dor"', "run -password zX91kkq7", 'P_W_D = "zX91kkq7"']
    got = S.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["name"]) for r in got) == [(0, "DB_PASS_PHRASE"), (1, "pass.code"), (2, "PASS_WORD"), (3, "password"), (4, "P_W_D")]


@pytest.mark.parametrize("text,name,literal", FOUND)
def test_found(text, name, literal):
    got = {(f.name, f.digest) for f in S.findings(text)}
    assert (name, hashlib.sha256(literal.encode()).hexdigest()) in got


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert S.findings(text) == []


def test_places_and_prefilter(spark):
    prose = words(4, 300)
    rows = [(i, f"{prose}\n{prose} {text}", "en", "s", 1) for i, (text, _, _) in enumerate(FOUND)] + [(100 + i, t, "en", "s", 1) for i, t in enumerate(CLEAN)]
    got = S.secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    want = {(r[0], *f) for r in rows for f in S.findings(r[1])}
    assert {tuple(g) for g in got} == want and {g["doc_id"] for g in got} == set(range(len(FOUND)))
    f = S.findings(f'x\ny token = "{KEY}"')[0]
    assert (f.line, f.start, f.length, f.kind) == (2, 12, 40, "string") or (f.line, f.length, f.kind) == (2, 40, "string")


def test_secret_hard_rows(spark):
    rows = hard_rows() + [(None, f'token = "{KEY}"', None, None, None)] * 2 + [(500, words(9, 50_000) + f' token="{KEY}"', "en", "s", 1)]
    got = S.secrets(clashing(spark, rows)).collect()
    assert sorted((g["doc_id"] is None, g["name"]) for g in got) == [(False, "token"), (True, "token"), (True, "token")]
    assert S.secrets(empty(spark)).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (1, 4, "Assistant ", "yes"), (1, 5, "assistant", ""), (2, 0, "assistant", "first"), (3, 1, "user", "only"),
    (None, 0, "assistant", "lost"), (4, 0, None, "who"), (4, None, "user", "early"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, 1, "assistant", "tie"),
]


def expand(rows):
    out = []
    for conv in sorted({r[0] for r in rows if r[0] is not None}):
        own = {(t, (role or "unknown").strip().lower() if role else "unknown", (x or "").replace("<|", "< |")) for c, t, role, x in rows if c == conv}
        turns = sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for n, (turn, role, text) in enumerate(turns):
            if role == "assistant" and text:
                prompt = "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in turns[:n]) + "<|assistant|>\n"
                target = text + C.END
                out.append((conv, turn, n, prompt, target, len(prompt), len(prompt) + len(target)))
    return sorted(out)


def test_chat_against_brute_force(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, prompt string, n_context int")
    got = sorted(tuple(r) for r in C.examples(df).select("conv_id", "turn", "n_context", "prompt", "target", "train_from", "train_to").collect())
    assert got == expand(TURNS) and len(got) == 5
    assert all((p + t)[a:b] == t for _, _, _, p, t, a, b in got), "only the reply is trainable"
    assert C.examples(df.limit(0)).count() == 0


def plain(text):
    """A plain reading of programs whose lines are ``name = part + part ...``: (name, SHA-256) of what sensitive names hold."""
    lines = [(k, *(x.strip() for x in line.split(" = ", 1))) for k, line in enumerate(text.split("\n"))]

    def meant(at, name):
        own = [k for k, n, _ in lines if n == name and k != at]
        return max((k for k in own if k < at), default=min(own, default=None))

    def reaches(at, goal, seen=()):
        nexts = [meant(at, p) for p in lines[at][2].split(" + ") if p[0] != '"']
        return any(k is not None and (k == goal or (k not in seen and reaches(k, goal, (*seen, k)))) for k in nexts)

    def value(at):
        parts = lines[at][2].split(" + ")
        out = []
        for p in parts:
            if p[0] == '"':
                out.append(p[1:-1])
                continue
            k = meant(at, p)
            known = None if k is None or reaches(k, at) else value(k)
            if known is None and len(parts) > 1:
                return None
            out.append(p if known is None else known)
        return "".join(out)

    found = set()
    for k, name, body in lines:
        weight, bits = S.sensitivity(name)
        literal = value(k) if weight else None
        if literal is None or literal == name:
            continue
        score = weight * S.strength(S.Value(len(literal), literal), bits)
        if body == literal and '"' not in body and not any(c.isdigit() for c in literal):
            score *= 0.4
        if score >= S.THRESHOLD:
            found.add((k + 1, name, len(literal), hashlib.sha256(literal.encode()).hexdigest()))
    return found


@pytest.mark.parametrize("seed", range(40))
def test_against_a_plain_reading(seed):
    """Drawn programs of up to 25 assignments, with cycles, repeated names and constants defined later."""
    import random

    rng = random.Random(seed)
    names = ["a", "b", "c", "base", "part", "token", "db_password", "api_key", "title"]
    part = lambda: rng.choice(names) if rng.random() < 0.5 else '"' + "".join(rng.choices("abcdxyz0189", k=rng.randrange(1, 14))) + '"'
    text = "\n".join(f"{rng.choice(names)} = {' + '.join(part() for _ in range(rng.choice([1, 1, 1, 2, 3])))}" for _ in range(rng.randrange(1, 26)))
    assert {(f.line, f.name, f.length, f.digest) for f in S.findings(text)} == plain(text)


def test_drawn_programs_have_findings():
    assert plain('a = "x1y2z3"\nb = a + "q9"\ndb_password = b') == {(3, "db_password", 8, hashlib.sha256(b"x1y2z3q9").hexdigest())}


def test_doubling_lines_are_reported_in_no_time():
    """A value too long to spell out keeps its length and score; only its digest is null."""
    lines = ['a0 = "x7"'] + [f"a{k + 1} = a{k} + a{k}" for k in range(200)]
    text = "\n".join([*lines, "password = a12", "db_password = a20", "api_token = a200"])
    got = {f.name: f for f in S.findings(text)}
    assert got["password"].digest == hashlib.sha256(("x7" * 4096).encode()).hexdigest()
    assert (got["db_password"].length, got["db_password"].digest, got["db_password"].score) == (2 << 20, None, 1.0)
    assert got["api_token"].length == (1 << 63) - 1


def test_constants_go_through_any_number_of_names():
    text = "\n".join(['n0 = "s3cr3tX9"', *(f"n{k + 1} = n{k}" for k in range(5000)), "db_password = n5000"])
    assert [(f.name, f.digest) for f in S.findings(text)] == [("db_password", hashlib.sha256(b"s3cr3tX9").hexdigest())]


def test_long_values_count_as_if_spelled_out():
    parts = [S.Value(len(t), t) for t in ("ab1" * 9000, "zz9 " * 10, "q" * 30000)]
    whole, spelled = S.joined(parts), "".join(p.text for p in parts)
    assert whole.text is None and whole.length == len(spelled)
    assert math.isclose(S.strength(whole, 10**6), S.strength(S.Value(len(spelled), spelled), 10**6))
    assert S.joined([whole, parts[0]]).ends == (spelled[:64], parts[0].text[-64:])
