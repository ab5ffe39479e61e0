"""Where a run's results go: messages, previews, quarantine, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from email.message import EmailMessage

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEGABYTE = 1 << 20


@dataclass(frozen=True)
class File:
    name: str
    data: bytes | None
    mime: str = "application/octet-stream"


@dataclass
class Digest:
    """A digest message and what became of its parts."""

    message: EmailMessage
    recipients: list[str]
    left_out: list[str] = field(default_factory=list)


def digest_message(subject: str, html: str, text: str, sender: str, recipients: Sequence[str], files: Iterable[File] = (), budget: int = 15 * MEGABYTE) -> Digest:
    """A message with a text and an HTML part.  Recipients stay in the envelope
    only.  Files are attached in order as long as they fit the budget; one that
    has no bytes, or doesn't fit, is left out and the next one is tried."""
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = " ".join(subject.split()), sender, "undisclosed-recipients:;"
    m.set_content(text or " ")
    m.add_alternative(html, subtype="html")
    out = Digest(m, list(dict.fromkeys(r.strip() for r in recipients if r.strip())))
    for f in files:
        if f.data and len(f.data) <= budget:
            budget -= len(f.data)
            main, _, sub = f.mime.partition("/")
            m.add_attachment(f.data, maintype=main, subtype=sub or "octet-stream", filename=f.name)
        else:
            out.left_out.append(f.name)
    return out


#: Sends a message to envelope recipients and returns those refused, as ``smtplib.SMTP.send_message`` does.
Send = Callable[[EmailMessage, str, list[str]], dict]


def deliver(digest: Digest, send: Send) -> list[str]:
    """The recipients refused; an error if there are none at all, or if all are refused."""
    if not digest.recipients:
        raise ValueError("a digest needs a recipient")
    refused = sorted(send(digest.message, digest.message["From"], digest.recipients) or {})
    if len(refused) == len(digest.recipients):
        raise RuntimeError("every recipient was refused")
    return refused


def preview(posts: DataFrame, show: Callable[[str], None] = print, most: int = 50) -> None:
    """A dry run: shows the first ``most`` posts (source_key, post_id, title) and commits nothing."""
    shown = posts.select("source_key", "post_id", "title").orderBy("source_key", "post_id").limit(most).collect()
    for r in shown:
        show(f"[{r['source_key']}] {r['title']} ({r['post_id']})")
    if not shown:
        show("nothing new")


def quarantine(pages: DataFrame, path: str, source: str, body: str, redact: Callable = lambda c: c) -> None:
    """Adds pages that couldn't be parsed to a table by source, redacted."""
    pages.select(source, F.current_timestamp().alias("at"), redact(F.col(body)).alias("body")).write.mode("append").partitionBy(source).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A report as JSON lines, a row each, null members kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
