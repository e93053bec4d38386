"""Private keys are redacted with their body."""

from __future__ import annotations

from dubsar.llm import secret_scans

BODY = "\n".join(["MIIEpAIBAAKCAQEA7bq9+/" + "Ab0" * 14] * 25 + ["a0f3" * 6, "q8Zc="])


def test_private_keys_go_whole(spark):
    begin, end = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"
    one = lambda kind, body: begin.format(kind) + body + end.format(kind)
    cases = {
        "a " + one("RSA ", f"\n{BODY}\n") + " b": "a [REDACTED-PEM] b",
        "secret = " + one("", f"\n{BODY}\n") + "\nb": "secret = [REDACTED-PEM]\nb",
        one("EC ", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0F\n\n" + BODY + "\n") + one("", "\n" + BODY + "\n"): "[REDACTED-PEM][REDACTED-PEM]",
        '{"k": "' + one("", "\\n" + BODY.replace("\n", "\\n") + "\\n") + '"}': '{"k": "[REDACTED-PEM]"}',
        "a " + begin.format("") + "\n" + BODY + "\nThat was it, no end.": "a [REDACTED-PEM]\nThat was it, no end.",
        begin.format("RSA ") + "\n" + BODY[:90]: "[REDACTED-PEM]",
        begin.format("") + "\n" + BODY + "\n" + one("EC ", "\nabcd\n"): "[REDACTED-PEM]\n[REDACTED-PEM]",
        "the line " + begin.format("") + " opens a key, as you know.": "the line [REDACTED-PEM] opens a key, as you know.",
        begin.format("") + "\n" + "Ab0+" * 400_000: "[REDACTED-PEM]",
        begin.format("") + "\n" + (BODY + "\n") * 2_000 + end.format(""): "[REDACTED-PEM]",
    }
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(cases)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secret_scans.cleaned(docs).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i]["text"][:300], got[i]["n_chars"]) == (want, len(want)), i
