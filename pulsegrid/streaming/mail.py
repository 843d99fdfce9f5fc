"""Mail worker stream (S2, S6, J5, R7 consumer side).

Mail requests arrive as JSON messages on a log (seq, value) with the
reference's field names (``Mail.From/To/Subject/Body/Attachments``). Each
micro-batch is decoded, its attachments are looked up in the attachment
store (a static DataFrame of file names, e.g. ``list_attachment_files``),
and every mail gets ``ready`` = all attachments found (a mail without
attachments is ready). Results are written per batch id with overwrite, so
a replayed batch rewrites the same folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.messages import is_text, last, like, members, parsed_json, text
from pulsegrid.operators.messages import mail_ready


def mail_json(mail_id: str = "mail_id", attachments: str = "attachments") -> F.Column:
    """Encode a mail request message; ``attachments`` is an array of file names."""
    return F.to_json(F.struct(F.struct(
        F.lit("").alias("From"), F.array().cast("array<string>").alias("To"),
        F.lit("").alias("Subject"), F.lit("").alias("Body"),
        F.transform(F.col(attachments),
                    lambda f: F.struct(f.alias("Filename"),
                                       F.lit(None).cast("binary").alias("Data"))
                    ).alias("Attachments")).alias("Mail")))


def decode_mail(messages: DataFrame) -> DataFrame:
    """(seq, value) -> (mail_id, Mail) with the attachments' file names.

    A message is dropped when it is not exactly one JSON object or a part has
    another type than the mail structs; a missing or null part is empty.
    Members are matched in any case.
    """
    m = parsed_json(messages).where(like("fields", "Mail", "^(VOID|OBJECT)"))
    m = m.select("seq", F.inline(F.array(F.struct(members(last("fields", "Mail")).alias("mail")))))
    m = m.where(is_text("mail", "From") & is_text("mail", "Subject") & is_text("mail", "Body")
                & like("mail", "To", r"^(VOID|ARRAY<(VOID|STRING)>)$")
                & like("mail", "Attachments", r"^(VOID|ARRAY<(VOID|OBJECT<.*>)>)$"))
    items = F.transform(F.try_variant_get(last("mail", "Attachments"), "$", "array<variant>"), members)
    m = m.select("seq", F.inline(F.array(F.struct(items.alias("items")))))
    # attachments: objects whose Filename and Data are text or null
    m = m.where(F.coalesce(F.forall("items", lambda a: is_text(a, "Filename") & is_text(a, "Data")), F.lit(True)))
    names = F.transform("items", lambda a: F.struct(text(a, "Filename").alias("Filename")))
    return m.select(F.col("seq").alias("mail_id"), F.struct(names.alias("Attachments")).alias("Mail"))


def mail_batch_writer(files: DataFrame, out_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        res = mail_ready(decode_mail(batch), files)
        (res.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))
    return write


def start_mail_worker(messages: DataFrame, files: DataFrame, out_path: str, checkpoint: str,
                      available_now: bool = True, processing_time: str = "1 second"):
    w = (messages.writeStream.foreachBatch(mail_batch_writer(files, out_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def read_mail_results(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path).select("mail_id", "ready")
