"""No byte of a private key is left after redaction."""

import random
import string

import corpus
from plumbline.llm import secrets


def test_whole_key_goes(spark, tmp_path):
    rng = random.Random(3)
    b64 = string.ascii_letters + string.digits + "+/"
    body = ["".join(rng.choices(b64, k=64)) for _ in range(25)] + ["".join(rng.choices(b64, k=10)) + "=="]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    key = "\n".join(body)
    coded = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n"
    texts = [f"before\n{head}\n{key}\n{end}\nafter these words", f"before\n{head}\n{coded}{key}\n{end}\nafter these words", f"before\n{head}\n{key}\nafter these words"]
    docs = corpus.table(spark, [(k, t, "en", "s", len(t), "", k, "") for k, t in enumerate(texts)])
    got = secrets.redacted(docs, secrets.secret_scan(docs, str(tmp_path / "ledger"))).collect()
    assert [r["text"] for r in got] == ["before\n[SECRET]\nafter these words"] * 3


def test_keys_of_any_length_and_label(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n=64: "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n))
    long = "\n".join(line() for _ in range(5000))
    texts = [
        f"before\n-----BEGIN RSA PRIVATE KEY-----\n{long}\n-----END RSA PRIVATE KEY-----\nafter these words",
        f"before\n-----BEGIN PRIVATE KEY-----\n{long}\n{line(9)}==\nafter these words",
        f"before\n-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2.0-beta\nComment: a - b\n\n{line()}\n{line(30)}\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----\nafter these words",
        f"before\n-----BEGIN OPENSSH PRIVATE KEY-----\n{line(70)}\n-----END OPENSSH PRIVATE KEY-----\nafter these words",
        "before\n-----BEGIN EC PUBLIC KEY-----\nabc\n-----END EC PUBLIC KEY-----\nafter these words",
    ]
    docs = corpus.table(spark, [(k, t, "en", "s", len(t), "", k, "") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(docs, secrets.secret_scan(docs, str(tmp_path / "ledger"))).collect()}
    assert [got[k] for k in range(4)] == ["before\n[SECRET]\nafter these words"] * 4 and got[4] == texts[4]

