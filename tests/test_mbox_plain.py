"""Messages that need no MIME parser get what it would give."""

import email
import random

import pandas as pd

from lexiflow.sources import mbox as MB


def parsed(raws):
    out = next(MB._mime_parts(iter([pd.DataFrame({"raw": raws})])))
    return list(zip(out["body"], out["attachments"]))


def test_plain_messages_equal_the_parser(monkeypatch):
    rng = random.Random(7)
    pieces = ["From: a", "Subject: x", "X-Y:", "Content-Type: text/html", "content-transfer-encoding: base64", "MIME-Version: 1.0",
              " folded", "\tfolded", "no header", ": nameless", "bad name: x", "", "", "aGk=", "body", "caf\u00e9", "a\x0bb", "a\x0cb: c",
              "Content-Disposition: attachment", "Contents: no", "\x1c: y"]
    raws = ["", "\n", "A: b", "A: b\n", "A: b\n\n", "A: b\r\n\r\nx\r\n", "A: b\r\rx", "A: b\rContent-Type: text/html\n\nx", "A: b\n\rx"]
    for _ in range(4000):
        end = rng.choice(("\n", "\n", "\r\n", "\r"))
        raws.append("".join(rng.choice(pieces) + (end if rng.random() < 0.95 else "\r") for _ in range(rng.randint(1, 7))))
    fast = parsed(raws)
    monkeypatch.setattr(MB, "PLAIN_HEAD", "(?!)")
    assert fast == parsed(raws)


def test_plain_messages_skip_the_parser(monkeypatch):
    def never(*a, **k):
        raise AssertionError("parsed")
    monkeypatch.setattr(email, "message_from_string", never)
    assert parsed(["From: a\r\nDate: b\r\n\r\nSender: c\r\n"]) == [("Sender: c\r\n", [])]


def test_read_mbox_keeps_its_archive_compressed(spark, tmp_path, monkeypatch):
    from lexiflow.plans import registry as R
    m = spark.createDataFrame([(f"{i}-1", f"S#{i} <s.{i}@fr.example>", "C#1 <c.1@de.example>", "Mon, 02 Jan 1995 00:00:00 +0000", i % 3 == 0)
                               for i in range(200)], "msg_id string, from string, comments_to string, date_raw string, is_target boolean")
    monkeypatch.setattr(R.S, "messages", lambda spark, sf_dir: m.repartition(3))
    monkeypatch.setattr(R, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = {r["msg_id"]: (r["from"], r["date_raw"], r["sender"], r["body"]) for r in R.QUERIES["read_mbox"](spark, None).collect()}
    assert got == {r["msg_id"]: (r["from"], r["date_raw"], None, f"Sender: body of {r['msg_id']}") for r in m.collect()}
    files = [f for f in (tmp_path / "mbox").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".gz") for f in files)
