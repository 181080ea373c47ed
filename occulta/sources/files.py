"""Documents from files: formats, text, mail, folders; lists, logs and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quality import garbled, sparse, without_barcodes

MOST_LISTED, MOST_MAIL = 500, 50
#: First bytes of formats, in the order of tests.
MAGIC = (("pdf", "25504446"), ("docx", "504B0304"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"))
IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "tiff", "tif", "webp", "heic")


def read_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, mtime, content, content_hash) of files; unread columns aren't loaded.

    Spark's reader passes over files without any byte.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").cast("double").alias("mtime"), "content", F.sha2("content", 256).alias("content_hash"))


def format_of(path: str = "path", content: str = "content") -> str:
    """SQL: a file's format by its first bytes, else its extension; a zip is a document only by name."""
    ext = f"lower(regexp_extract({path}, r'\\.([^./]+)$', 1))"
    tests = " ".join(f"WHEN substring({content}, 1, {len(h) // 2}) = X'{h}'{f' AND {ext} = {f!r}' if f == 'docx' else ''} THEN '{f}'" for f, h in MAGIC)
    return f"CASE {tests} WHEN substring({content}, 1, 4) = X'52494646' AND substring({content}, 9, 4) = X'57454250' THEN 'webp' WHEN {ext} = 'pdf' THEN 'pdf' WHEN {ext} IN {IMAGES!r} THEN 'image' ELSE 'text' END"


def docx_text(raw: bytes) -> str:
    """One line for each paragraph of a Word document."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


_STRING = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>"


def pdf_string(raw: bytes) -> str:
    """The text of a PDF string, written in parentheses or as hex digits; two-byte text if it begins with its mark."""
    import re

    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1]).decode()
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        data = re.sub(rb"\\([0-7]{1,3})", lambda k: bytes([int(k[1], 8) & 255]), raw[1:-1])
        data = re.sub(rb"\\(.)", lambda k: {b"n": b"\n", b"t": b"\t", b"r": b"\r"}.get(k[1], k[1]), data)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")


def pdf_text(raw: bytes) -> tuple[str, int]:
    """Text and number of pages of a PDF with plain or deflated content streams.

    Fonts with their own codes (CID) are read as bytes, so their text may come
    out garbled, which ``extract`` notices; encrypted files raise an error.
    """
    import re
    import zlib

    if b"/Encrypt" in raw:
        raise ValueError("encrypted")
    pages = len(re.findall(rb"/Type\s*/Page(?![a-z])", raw))
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        data = m[1]
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        if b"BT" not in data:
            continue
        lines = []
        for block in re.findall(rb"BT(.*?)ET", data, re.S):
            for part in re.findall(_STRING + rb"|T\*|Td|TD|'", block):
                if part[:1] in (b"(", b"<"):
                    lines.append(pdf_string(part))
                elif lines and not lines[-1].endswith("\n"):
                    lines.append("\n")
            lines.append("\n")
        out.append("".join(lines).strip("\n"))
    return "\n".join(out), pages


def looks_garbled(text: str) -> bool:
    """The same test as ``quality.garbled``, for a text in Python: few spaces, over-long words, capitals glued to words."""
    import re

    words = text.split()
    if not words or text.count(" ") / len(text) >= 0.10 or len(re.findall(r"[a-z][A-Z]|[A-Z]{2,}[a-z]", text)) < 3:
        return False
    return sum(len(w) > 25 and not re.match(r"(?i)https?://|www\.|\S+@\S+\.\S+", w) for w in words) / len(words) >= 0.03


def extract(files: DataFrame, ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """``files(path, content, ...)`` with text, n_pages, error, garbled, sparse.

    Word and PDF are read, images given to ``ocr``, all else decoded as UTF-8.
    What can't be read has no text and an error; nothing fails the job.
    Barcode blocks are replaced whatever the format. An empty file is an empty
    text. If ``ocr`` is given, PDFs without text, thin or garbled ones go to
    it too; its text counts if longer, or if the PDF's own is garbled and it
    isn't.
    """
    kept = [f for f in files.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, pages, errors = [], [], []
            for form, raw in zip(b["__format"], b["content"]):
                text, n, error = None, 0, None
                try:
                    raw = bytes(raw or b"")
                    if form == "pdf":
                        text, n = pdf_text(raw)
                        if ocr and (not text.strip() or (n >= 2 and len(text) / n < 120)):
                            text = max((ocr(raw) or "", text), key=len)
                        elif ocr and looks_garbled(text):
                            other = ocr(raw) or ""
                            text = text if not other.strip() or looks_garbled(other) else other
                        if not text.strip():
                            text, error = None, "no text"
                    elif form == "docx":
                        text = docx_text(raw)
                    elif form == "text":
                        text = raw.decode("utf-8", "replace")
                    elif ocr:
                        text = ocr(raw)
                    else:
                        error = "no ocr"
                except Exception as e:  # noqa: BLE001 - a file that can't be read is a row
                    error = type(e).__name__
                texts.append(text), pages.append(n), errors.append(error)
            yield b.drop(columns="__format").assign(text=texts, n_pages=pages, error=errors)

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_pages", T.IntegerType()), T.StructField("error", T.StringType())])
    read = files.withColumn("__format", F.expr(format_of())).mapInPandas(run, schema)
    return read.withColumn("text", F.expr(without_barcodes("text"))).withColumn("garbled", F.expr(garbled("text"))).withColumn("sparse", F.expr(f"coalesce({sparse('text', 'n_pages')}, false)"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, modality, truncated) of a folder's own files, by lower-case name, ``MOST_LISTED`` at most."""
    files = spark.read.format("binaryFile").load(folder.rstrip("/") + "/*").select(F.expr("substring_index(path, '/', -1)").alias("name"), F.col("length").alias("size"))
    ext = "lower(regexp_extract(name, r'\\.([^.]+)$', 1))"
    modality = F.expr(f"CASE WHEN {ext} IN {IMAGES!r} THEN 'image' WHEN {ext} = 'pdf' THEN 'pdf' WHEN {ext} IN ('doc', 'docx', 'odt') THEN 'document' WHEN {ext} IN ('csv', 'xls', 'xlsx') THEN 'table' ELSE 'text' END")
    more = files.count() > MOST_LISTED
    return files.withColumn("modality", modality).orderBy(F.lower("name"), "name").limit(MOST_LISTED).withColumn("truncated", F.lit(more))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("sender", "subject", "body")]))
def parse_mail(raw: pd.Series) -> pd.DataFrame:
    """Sender, subject and first plain text of RFC 822 messages, whatever the charset."""
    import email
    from email.header import decode_header

    def header(value: str | None) -> str:
        parts = []
        for text, charset in decode_header(value or ""):
            if isinstance(text, bytes):
                try:
                    text = text.decode(charset or "utf-8", "replace")
                except LookupError:
                    text = text.decode("latin-1")
            parts.append(text)
        return "".join(parts)

    def body(message) -> str:
        for part in message.walk():
            if part.get_content_type() == "text/plain" and part.get_content_disposition() != "attachment":
                data = part.get_payload(decode=True) or b""
                try:
                    return data.decode(part.get_content_charset() or "utf-8", "replace")
                except LookupError:
                    return data.decode("latin-1")
        return ""

    messages = [email.message_from_bytes(bytes(r or b"")) for r in raw]
    return pd.DataFrame({"sender": [header(m["From"]) for m in messages], "subject": [header(m["Subject"]) for m in messages], "body": [body(m) for m in messages]})


def read_mail(spark: SparkSession, folder: str, most: int = MOST_MAIL) -> DataFrame:
    """(uid, from, subject, body) of the last ``most`` (1 to 50) exported messages: numbers as such, then other names."""
    n = max(1, min(MOST_MAIL, most))
    files = read_files(spark, folder, "*.eml")
    last = files.withColumn("uid", F.expr(r"regexp_extract(path, r'([^/]+)\.eml$', 1)")).orderBy(F.expr("try_cast(uid AS decimal(38, 0))").desc_nulls_first(), F.desc("uid")).limit(n)
    return last.withColumn("m", parse_mail("content")).select("uid", F.col("m.sender").alias("from"), "m.subject", "m.body")


def read_list(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    """Entries of a JSON list file; a missing or broken file is an empty list."""
    try:
        rows = spark.read.option("multiLine", "true").schema(f"version int, {field} array<{schema}>").json(path).select(F.explode(field).alias("x"))
        rows.limit(1).collect()
    except Exception:  # noqa: BLE001 - a list that can't be read is empty
        rows = spark.createDataFrame([], f"x {schema}")
    return rows.select("x.*") if schema.startswith("struct") else rows


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit log's lines; none if there is no log."""
    schema = "timestamp string, mission string, event string, counts map<string,string>, total int, safe_to_send boolean, file_count int"
    try:
        df = spark.read.schema(schema).json(path)
        df.limit(1).collect()
        return df
    except Exception:  # noqa: BLE001 - no log yet
        return spark.createDataFrame([], schema)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


#: Documents of a dossier in one ZIP file; larger dossiers have several.
ZIP_DOCUMENTS = 2000


def write_dossier(masked: DataFrame, vault: DataFrame, path: str) -> DataFrame:
    """One ZIP file for each dossier of ``masked(dossier, name, masked)``, and the vault as tab-separated text.

    A ZIP holds ``anonymise/NN - name.txt`` for each document, by name, and
    ``manifest.json``, which lists them. A dossier of more than
    ``ZIP_DOCUMENTS`` documents is dealt to several ZIPs by name. Returns
    (dossier, part, file, n_documents). The files come from tasks, under names
    of their own first, so that a lost task leaves no half file.
    """
    sizes = masked.groupBy("dossier").agg(F.ceil(F.count("*") / ZIP_DOCUMENTS).cast("int").alias("parts"))
    dealt = masked.join(sizes, "dossier").select("dossier", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("masked", F.lit("")).alias("masked"))

    def store(group: pd.DataFrame) -> pd.DataFrame:
        import io
        import json
        import os
        import re
        import uuid
        import zipfile

        dossier, part = str(group["dossier"].iloc[0]), int(group["part"].iloc[0])
        rows, buffer = group.sort_values("name"), io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            names = []
            for k, (name, text) in enumerate(zip(rows["name"], rows["masked"]), 1):
                names.append(f"anonymise/{k:02d} - {re.sub(r'[^\w .-]', '_', name)}.txt")
                z.writestr(names[-1], text)
            z.writestr("manifest.json", json.dumps({"dossier": dossier, "part": part, "documents": names}, ensure_ascii=False))
        base = path.removeprefix("file://")
        target = f"{base}/dossiers/{re.sub(r'[^\w.-]', '_', dossier)}-{part:04d}.zip"
        if "://" in base:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(target)
            own = f"{at}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(own) as f:
                f.write(buffer.getvalue())
            system.move(own, at)
        else:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            own = f"{target}.{uuid.uuid4().hex}.part"
            with open(own, "wb") as f:
                f.write(buffer.getvalue())
            os.replace(own, target)
        return pd.DataFrame({"dossier": [dossier], "part": [part], "file": [target], "n_documents": [len(rows)]})

    done = dealt.groupBy("dossier", "part").applyInPandas(store, "dossier string, part int, file string, n_documents long")
    done.write.mode("overwrite").parquet(f"{path}/manifest")
    vault.select("mission", "token", "type", "value").write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{path}/correspondance")
    return masked.sparkSession.read.parquet(f"{path}/manifest")


def restored_files(restored: DataFrame, path: str, allowed: str = "true") -> DataFrame:
    """Restored texts (name, restored, n_restored, n_unresolved) written to ``path``, and a report without them: counts, bytes, refused.

    Only rows for which ``allowed`` (SQL, such as ``index.protected``) holds are
    written; an unknown answer refuses.
    """
    checked = restored.withColumn("refused", ~F.coalesce(F.expr(allowed), F.lit(False)))
    checked.filter("NOT refused").select("name", "restored").write.mode("overwrite").parquet(path)
    return checked.select("name", "n_restored", "n_unresolved", F.when(F.col("refused"), 0).otherwise(F.octet_length("restored")).alias("n_bytes"), "refused")


#: Times a file is tried, and the seconds between.
TRIES, PAUSE = 3, 0.2


def probe(paths: DataFrame) -> DataFrame:
    """``paths(path)`` with ``status``: ``ok``, or ``deferred`` for files of which no byte can be had in ``TRIES`` tries.

    Files that a store has not fetched yet are left for the next sweep rather
    than failing it; an empty file is ok.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        def readable(path: str) -> bool:
            for k in range(TRIES):
                try:
                    local = path.removeprefix("file:") if path.startswith("file:") else path
                    if "://" in local:
                        from pyarrow import fs

                        system, at = fs.FileSystem.from_uri(local)
                        with system.open_input_stream(at) as f:
                            f.read(1)
                    else:
                        with open("/" + local.lstrip("/"), "rb") as f:
                            f.read(1)
                    return True
                except OSError:
                    if k + 1 < TRIES:
                        time.sleep(PAUSE)
            return False

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "status": ["ok" if p is not None and readable(p) else "deferred" for p in b["path"]]})

    return paths.select("path").mapInPandas(run, "path string, status string")


#: Own lists: ends of text files that a scan before publishing reads, and folders of made-up data that it leaves out.
SCANNED_ENDS = ("cfg", "conf", "css", "csv", "env", "html", "ini", "js", "json", "md", "py", "rst", "sh", "sql", "toml", "ts", "txt", "xml", "yaml", "yml")
SYNTHETIC = ("fixtures", "samples", "synthetic", "testdata")


def scannable(path: str = "path") -> str:
    """SQL: whether a scan before publishing reads a file: a text by its end or a name without one, in no folder of made-up data or of a tool."""
    ends = ", ".join(f"'{e}'" for e in SCANNED_ENDS)
    folders = ", ".join(f"'{f}'" for f in SYNTHETIC)
    name = f"substring_index({path}, '/', -1)"
    parts = f"slice(split({path}, '/'), 1, size(split({path}, '/')) - 1)"
    return f"((NOT contains({name}, '.') OR lower(substring_index({name}, '.', -1)) IN ({ends})) AND NOT exists({parts}, f -> lower(f) IN ({folders}) OR (f LIKE '.%' AND f <> '.')))"


def labels_for_journal(labels: str) -> str:
    """SQL: mail labels for a log: flags and the fixed set stay, others are only ``custom-label``."""
    fixed = ", ".join(map(repr, ("INBOX", "À traiter", "Clients", "Factures", "Archive")))
    return f"transform({labels}, l -> CASE WHEN startswith(l, '\\\\') OR l IN ({fixed}) THEN l ELSE 'custom-label' END)"
