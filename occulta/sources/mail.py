"""A mailbox as a data source: ``spark.read.format("occulta_mail")``, and ``readStream`` for what arrives.

Messages are read over IMAP, read-only and without marking them as seen, by the
workers: the driver only asks for the mailbox's next number, and deals the
numbers (UIDs) to partitions by ranges. Filters on ``uid`` narrow the ranges, so
that partitions without a wanted number aren't made, and filters on ``received``
become the server's own search by day (Spark filters again, to the second).
``spark.sql.python.filterPushdown.enabled`` must be on for that.

Options: ``host``, ``port``, ``user``, ``mailbox`` (INBOX), ``security`` (``ssl``
unless it is ``none``, for servers on the same machine only), ``query`` (an IMAP
search, ALL), ``uids_per_partition`` (1000), ``last`` (only the last so many, 1
to ``MOST_MAIL``). The password comes from ``password_file``, which workers must
be able to read, or from ``password``, which Spark hides in plans and logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import MOST_MAIL, parse_mail

SCHEMA = "uid bigint, received timestamp, content binary"
#: Messages that one request fetches, so that a worker holds a few at a time.
FETCHED_AT_ONCE = 20


def mail_source() -> type[DataSource]:
    """The source's class; made in a function so that it travels to the workers by value."""
    import contextlib
    import datetime
    import imaplib
    import ipaddress
    import re

    most, at_once, schema = MOST_MAIL, FETCHED_AT_ONCE, SCHEMA
    months = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

    class Range(InputPartition):
        def __init__(self, low: int, high: int):
            self.low, self.high = low, high

    class Mailbox:
        """Connections and requests, as the options say."""

        def __init__(self, options):
            self.options = dict(options)
            self.size = max(1, int(self.options.get("uids_per_partition", 1000)))
            self.query = self.options.get("query", "ALL")
            if re.search(r"[\r\n\0]", self.query) or re.search(r"[\r\n\0]", self.options.get("mailbox", "INBOX")):
                raise ValueError("query and mailbox are one line each")
            missing = [o for o in ("host", "user") if not self.options.get(o)]
            if missing:
                raise ValueError(f"options missing: {', '.join(missing)}")

        def password(self) -> str:
            if self.options.get("password_file"):
                with open(self.options["password_file"], encoding="utf-8") as f:
                    return f.read().strip()
            return self.options.get("password", "")

        @contextlib.contextmanager
        def opened(self):
            o = self.options
            host = o["host"]
            if o.get("security", "ssl") == "none":
                try:
                    near = ipaddress.ip_address(host).is_loopback
                except ValueError:
                    near = host == "localhost"
                if not near:
                    raise ValueError("a connection without encryption is for this machine only")
                box = imaplib.IMAP4(host, int(o.get("port", 143)), timeout=60)
            else:
                box = imaplib.IMAP4_SSL(host, int(o.get("port", 993)), timeout=60)
            try:
                box.login(o["user"], self.password())
                name = o.get("mailbox", "INBOX").replace("\\", "\\\\").replace('"', '\\"')
                status, _ = box.select(f'"{name}"', readonly=True)
                if status != "OK":
                    raise OSError("the mailbox can't be opened")
                yield box
            finally:
                with contextlib.suppress(Exception):
                    box.logout()

        def bounds(self) -> tuple[int, int]:
            """The mailbox's validity and its next number."""
            with self.opened() as box:
                valid, coming = box.response("UIDVALIDITY")[1], box.response("UIDNEXT")[1]
                if not coming or coming[0] is None:
                    raise OSError("the server doesn't tell the next number")
                return int(valid[0]) if valid and valid[0] else 0, int(coming[0])

        def found(self, box, low: int, high: int, days: tuple[str, ...] = ()) -> list[int]:
            status, data = box.uid("SEARCH", None, "UID", f"{low}:{high}", *days, self.query)
            if status != "OK":
                raise OSError("the search failed")
            return [n for n in sorted({int(x) for x in (data[0] or b"").split()}) if low <= n <= high]  # n:* holds the last one whatever n is

        def messages(self, low: int, high: int, days: tuple[str, ...] = ()):
            with self.opened() as box:
                numbers = self.found(box, low, high, days)
                for k in range(0, len(numbers), at_once):
                    asked = numbers[k : k + at_once]
                    status, data = box.uid("FETCH", ",".join(map(str, asked)), "(UID INTERNALDATE BODY.PEEK[])")
                    if status != "OK":
                        raise OSError("messages can't be fetched")
                    rows = {}
                    for part in data:
                        if isinstance(part, tuple):
                            head = part[0]
                            number = re.search(rb"UID (\d+)", head)
                            when = re.search(rb'INTERNALDATE "([^"]+)"', head)
                            if number:
                                at = datetime.datetime.strptime(when[1].decode().strip(), "%d-%b-%Y %H:%M:%S %z") if when else None
                                rows[int(number[1])] = (int(number[1]), at, bytes(part[1]))
                    yield from (rows[n] for n in asked if n in rows)  # one that went meanwhile is gone

        def ranges(self, low: int, high: int) -> list[Range]:
            return [Range(at, min(at + self.size - 1, high)) for at in range(low, high + 1, self.size)]

    class Reader(DataSourceReader):
        def __init__(self, box: Mailbox):
            self.box, self.low, self.high, self.only, self.days = box, 1, None, None, ()

        def pushFilters(self, filters):
            for f in filters:
                column = ".".join(f.attribute) if hasattr(f, "attribute") else None
                value = getattr(f, "value", None)
                if column == "uid" and isinstance(f, (EqualTo, In)):
                    wanted = {int(v) for v in (value if isinstance(f, In) else [value]) if v is not None}
                    self.only = wanted if self.only is None else self.only & wanted
                elif column == "uid" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, int(value) + isinstance(f, GreaterThan))
                elif column == "uid" and isinstance(f, (LessThan, LessThanOrEqual)):
                    top = int(value) - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
                else:
                    if column == "received" and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                        # the server's days are its own zone's: a day more on either side
                        late = isinstance(f, (LessThan, LessThanOrEqual))
                        day = value.date() + datetime.timedelta(days=2 if late else -1)
                        self.days += ("BEFORE" if late else "SINCE", f"{day.day:02d}-{months[day.month - 1]}-{day.year}")
                    yield f

        def partitions(self):
            high = self.box.bounds()[1] - 1
            last = self.box.options.get("last")
            if last is not None:
                # the last so many of all that the search finds: a filter of Spark's comes after
                n, top = max(1, min(int(last), most)), high
                picked: list[int] = []
                with self.box.opened() as box:
                    while top >= 1 and len(picked) < n:
                        picked = self.box.found(box, max(1, top - self.box.size + 1), top) + picked
                        top -= self.box.size
                picked = picked[-n:]
                wanted = {u for u in picked if self.only is None or u in self.only}
            else:
                wanted = self.only
            high = high if self.high is None else min(high, self.high)
            if wanted is not None:
                return [Range(u, u) for u in sorted(wanted) if self.low <= u <= high] or [Range(1, 0)]
            return self.box.ranges(self.low, high) or [Range(1, 0)]

        def read(self, partition):
            if partition.low <= partition.high:
                yield from self.box.messages(partition.low, partition.high, self.days)

    class Arrivals(DataSourceStreamReader):
        def __init__(self, box: Mailbox):
            self.box = box

        def initialOffset(self) -> dict:
            return {"validity": self.box.bounds()[0], "next": 1}

        def latestOffset(self) -> dict:
            valid, coming = self.box.bounds()
            return {"validity": valid, "next": coming}

        def partitions(self, start: dict, end: dict):
            if start["validity"] != end["validity"]:
                raise RuntimeError("the mailbox was numbered anew: the stream must start from a new checkpoint")
            return self.box.ranges(start["next"], end["next"] - 1)

        def read(self, partition):
            yield from self.box.messages(partition.low, partition.high)

        def commit(self, end: dict) -> None:
            pass

    class MailSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "occulta_mail"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(Mailbox(self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            if "last" in self.options:
                raise ValueError("a stream has no last messages")
            return Arrivals(Mailbox(self.options))

    return MailSource


def register(spark: SparkSession) -> None:
    """Make ``occulta_mail`` known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(mail_source())


def parsed(messages: DataFrame) -> DataFrame:
    """(uid, received, from, subject, body) of messages; still in clear, for a masker."""
    return messages.withColumn("m", parse_mail("content")).select("uid", "received", F.col("m.sender").alias("from"), "m.subject", "m.body")
