"""The mailbox source against a small server: ranges, filters, streams and restarts."""

import datetime
import re
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from occulta.sources import mail


class Server(socketserver.ThreadingTCPServer):
    """Speaks as much IMAP as the source needs; keeps what it was asked for."""

    allow_reuse_address = daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Session)
        self.messages, self.validity, self.asked = {}, 7, []

    def add(self, uid, subject, day, body="x"):
        raw = f"From: =?utf-8?q?Zo=C3=A9?= <z{uid}@a.example>\r\nSubject: {subject}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n{body}".encode()
        self.messages[uid] = (datetime.datetime(2024, 3, day, 12, tzinfo=datetime.UTC), raw)

    @property
    def options(self):
        return {"host": "127.0.0.1", "port": str(self.server_address[1]), "user": "u", "password": "s3cret", "security": "none", "uids_per_partition": "10"}


class Session(socketserver.StreamRequestHandler):
    def say(self, text):
        self.wfile.write(text.encode() + b"\r\n")

    def handle(self):
        server = self.server
        self.say("* OK ready")
        while line := self.rfile.readline().decode().strip():
            tag, _, rest = line.partition(" ")
            if not rest.startswith(("LOGIN", "CAPABILITY", "LOGOUT")):
                server.asked.append(rest)
            if rest.startswith("LOGIN") and "s3cret" not in rest:
                self.say(f"{tag} NO wrong")
                continue
            if rest.startswith("CAPABILITY"):
                self.say("* CAPABILITY IMAP4rev1")
            elif rest.startswith("EXAMINE"):
                self.say(f"* {len(server.messages)} EXISTS\r\n* OK [UIDVALIDITY {server.validity}] ok\r\n* OK [UIDNEXT {max(server.messages, default=0) + 1}] ok")
            elif m := re.match(r"UID SEARCH UID (\d+):(\d+)(.*)", rest):
                low, high = int(m[1]), int(m[2])
                since, before = re.search(r"SINCE (\S+)", m[3]), re.search(r"BEFORE (\S+)", m[3])
                day = lambda x: datetime.datetime.strptime(x[1], "%d-%b-%Y").date()
                hits = [u for u, (at, raw) in server.messages.items() if low <= u <= high and (not since or at.date() >= day(since)) and (not before or at.date() < day(before)) and ("SUBJECT odd" not in m[3] or b"odd" in raw)]
                self.say("* SEARCH " + " ".join(map(str, hits)))
            elif m := re.match(r"UID FETCH (\S+) ", rest):
                for n, u in enumerate(map(int, m[1].split(",")), 1):
                    at, raw = server.messages[u]
                    self.wfile.write(f'* {n} FETCH (UID {u} INTERNALDATE "{at:%d-%b-%Y %H:%M:%S +0000}" BODY[] {{{len(raw)}}}\r\n'.encode() + raw + b")\r\n")
            self.say(f"{tag} OK done")
            if rest.startswith("LOGOUT"):
                return


@pytest.fixture
def server(spark):
    mail.register(spark)
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    for uid in (*range(1, 31), 33, 41):
        s.add(uid, "odd one" if uid % 2 else "even", 1 + uid % 28, "é" * uid)
    yield s
    s.shutdown()
    s.server_close()


def test_reads_all_once_and_marks_nothing(spark, server):
    df = spark.read.format("occulta_mail").options(**server.options).load()
    assert df.rdd.getNumPartitions() == 5
    got = mail.parsed(df).orderBy("uid").collect()
    assert [r.uid for r in got] == [*range(1, 31), 33, 41]
    assert got[2]["from"] == "Zoé <z3@a.example>" and got[2].subject == "odd one" and got[2].body == "ééé" and got[2].received.day == 4
    assert not any(re.search(r"SELECT|STORE|RFC822|BODY\[", a) for a in server.asked)
    assert max(len(a.split()[2].split(",")) for a in server.asked if a.startswith("UID FETCH")) <= mail.FETCHED_AT_ONCE


def test_filters_reach_the_server(spark, server):
    def read(condition):
        server.asked.clear()
        df = spark.read.format("occulta_mail").options(**server.options).load().filter(condition).select("uid")
        uids = sorted(r.uid for r in df.collect())
        return uids, [tuple(map(int, re.match(r"UID SEARCH UID (\d+):(\d+)", a).groups())) for a in server.asked if "SEARCH" in a]

    assert read("uid > 24 AND uid <= 33") == ([25, 26, 27, 28, 29, 30, 33], [(25, 33)])
    uids, ranges = read("uid IN (3, 41, 99)")
    assert uids == [3, 41] and sorted(ranges) == [(3, 3), (41, 41)]
    assert read("uid = 12 AND uid = 13") == ([], [])
    assert read("uid < 1") == ([], [])
    uids, _ = read("received >= timestamp'2024-03-26 00:00:00' AND uid < 31")
    assert uids == [25, 26, 27] and all("SINCE 25-Mar-2024" in a for a in server.asked if "SEARCH" in a)
    uids, _ = read("received < timestamp'2024-03-03 00:00:00'")
    assert uids == [1, 28, 29] and all("BEFORE 05-Mar-2024" in a for a in server.asked if "SEARCH" in a)


def test_last_and_search(spark, server):
    read = lambda **more: sorted(r.uid for r in spark.read.format("occulta_mail").options(**server.options, **more).load().select("uid").collect())
    assert read(last="4") == [29, 30, 33, 41]
    assert read(last="0") == [41] and len(read(last="1000")) == 32
    assert read(query="SUBJECT odd", last="3") == [29, 33, 41]


def test_empty_mailbox(spark, server):
    server.messages.clear()
    assert spark.read.format("occulta_mail").options(**server.options).load().isEmpty()


def test_refused(spark, server, tmp_path):
    def fails(match, **more):
        with pytest.raises(Exception, match=match):
            spark.read.format("occulta_mail").options(**{**server.options, **more}).load().count()

    fails("for this machine only", host="mail.example")
    fails("one line", query="ALL\r\nA1 DELETE INBOX")
    fails("wrong", password="other")
    secret = tmp_path / "secret"
    secret.write_text("s3cret\n")
    df = spark.read.format("occulta_mail").options(**{**server.options, "password": "other", "password_file": str(secret)}).load()
    assert df.count() == 32
    plain = spark.read.format("occulta_mail").options(**server.options).load()
    assert "s3cret" not in plain._jdf.queryExecution().toString()


def test_stream_goes_on_where_it_was(spark, server, tmp_path):
    def run():
        stream = spark.readStream.format("occulta_mail").options(**server.options).load()
        query = stream.select("uid", F.length("content").alias("n")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert query.exception() is None
        return sorted(r.uid for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [*range(1, 31), 33, 41]
    assert run() == first
    server.add(42, "new", 20)
    server.add(55, "new", 21)
    assert run() == [*first, 42, 55]
    assert run() == [*first, 42, 55]
    server.validity = 8
    server.add(56, "renumbered", 22)
    with pytest.raises(Exception, match="numbered anew"):
        run()
