import math
import random
import string
from collections import Counter

import duckdb
import pandas as pd

from sonde.llm import secrets as S

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
B64 = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zZ+/qwe"


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def test_incremental_counts_equal_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 5, 20, 21, 60, 300):
        for alphabet in ("ab", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/"):
            s = "".join(rng.choice(alphabet) for _ in range(n))
            want = max((entropy(s[i : i + 20]) for i in range(max(1, n - 19))), default=0.0)
            assert abs(S.window_entropy(s) - want) < 1e-9


def test_scan(spark):
    rows = [(1, f'é token = "{HEX}" and {B64}!', 1), (2, "an ordinary sentence of wordsthatarelongerthantwentyletters 12345678901234567890123", 2), (3, None, 3), (4, "", 4), (None, HEX, 5), (1, f"{HEX[:-1]}EXAMPLE", 6), (6, f"sha256-{B64}", 7), (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", 8), (8, "word " * 100000 + HEX, 9), (8, HEX + " " + HEX, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, begin int")
    got = sorted((tuple(r) for r in S.scan_secrets(df).collect()), key=str)
    h, b = round(S.window_entropy(HEX), 6), round(S.window_entropy(B64), 6)
    assert got == sorted([(1, 11, 51, "hex", h, "24be*40"), (1, 57, 94, "base64", b, "aB3d*37"), (None, 0, 40, "hex", h, "24be*40"), (8, 500000, 500040, "hex", h, "24be*40"), (8, 0, 40, "hex", h, "24be*40"), (8, 41, 81, "hex", h, "24be*40")], key=str)
    assert S.scan_secrets(df, allow_list=[HEX]).count() == 1 and S.scan_secrets(df.limit(0)).count() == 0


def test_sql():
    rng, b62 = random.Random(1), string.ascii_letters + string.digits
    rnd = lambda a, n: "".join(rng.choices(a, k=n))
    rows = []
    for i in range(400):
        forms = [f"AKIA{rnd(string.ascii_uppercase + string.digits, 16)}", f"token={rnd('0123456789abcdef', 40)}", f"sk_live_{rnd(b62, 24)}", f"x=y={rnd(b62, 30)}=={rnd('01', 25)}", rnd(b62, 22), f"example_api_key={rnd(b62, 30)}", f"sha256-{rnd(b62, 30)}", "a" * 30 + "1", f"AB-CD_{rnd(string.ascii_uppercase + '234567', 20)}", rnd("abc=-_1", 40)]
        rows.append((i, " ".join(["text", *rng.sample(forms, 4), "ü"])))
    documents = pd.DataFrame([*rows, (None, None), (400, "")], columns=["doc_id", "text"])
    scanner = S.Scanner()
    got = [(i, b, e, k, round(h, 6), f"{x[:4]}*{len(x)}") for i, t in rows for b, e, k, h, x in scanner.scan(t)]
    assert len(documents) == 402 and got and sorted(got) == sorted(duckdb.sql(S.OP3_SQL).fetchall())


def test_found_shares_of_random_keys_of_each_form():
    rng, scanner, hexa, b62 = random.Random(2), S.Scanner(), "0123456789abcdef", string.ascii_letters + string.digits
    forms = (("AKIA", string.ascii_uppercase + string.digits, 16, 0.95), ("AKIA", string.ascii_uppercase + "234567", 16, 0.95), ("api_key=", hexa, 32, 0.97), ("token=", hexa, 40, 0.97), ("sk_", hexa, 32, 0.97), ("example_api_key=", hexa, 40, 0.97), ("", b62, 20, 0.75), ("", hexa, 40, 0.97))
    for before, alphabet, n, least in forms:
        keys = [before + "".join(rng.choices(alphabet, k=n)) for _ in range(400)]
        found = sum(any(k.endswith(s) and len(s) >= n for *_, s in scanner.scan(f"a {k} b")) for k in keys)
        assert found >= least * len(keys), (before, n, found)
    for plain in (f"key={HEX[:-1]}EXAMPLE", "some_long_name_of_a_variable=another_long_name_2", "A_LONG_NAME_OF_A_CONSTANT_2024=1"):
        assert not list(scanner.scan(plain)), plain
    assert [x[:3] for x in scanner.scan(f"api_key={HEX}")] in ([(8, 48, "hex")], [(0, 48, "base64")])
