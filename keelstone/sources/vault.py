"""Item exports: reading with fail-fast checks, writing, discovery, and counting of raw snapshots."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_or_empty
from ..session import cut

# The item schema, in the names of the engine; left the path in an export, right the type.
ITEM_FIELDS: dict[str, tuple[str, str]] = {
    "id": ("id", "string"), "organization_id": ("organizationId", "string"), "folder_id": ("folderId", "string"), "cipher_type": ("type", "bigint"), "reprompt": ("reprompt", "bigint"), "favorite": ("favorite", "boolean"),
    "name": ("name", "string"), "notes": ("notes", "string"), "creation_date": ("creationDate", "string"), "revision_date": ("revisionDate", "string"), "deleted_date": ("deletedDate", "string"), "archived_date": ("archivedDate", "string"),
}
_IDENT = {"title": "title", "first_name": "firstName", "middle_name": "middleName", "last_name": "lastName", "address1": "address1", "address2": "address2", "address3": "address3", "city": "city", "state": "state", "postal_code": "postalCode", "country": "country", "company": "company", "email": "email", "phone": "phone", "ssn": "ssn", "username": "username", "passport_number": "passportNumber", "license_number": "licenseNumber"}
_CARD = {"cardholder_name": "cardholderName", "brand": "brand", "card_number": "number", "exp_month": "expMonth", "exp_year": "expYear", "card_code": "code"}
_SSH = {"private_key": "privateKey", "public_key": "publicKey", "key_fingerprint": "keyFingerprint"}


def strict(v: Column, path: str, kind: str) -> Column:
    """The value at path if it has just this kind, else null: no casts between kinds."""
    at = F.variant_get(v, f"$.{path}", "variant")
    is_kind = F.schema_of_variant(at) == {"string": "STRING", "bigint": "BIGINT", "boolean": "BOOLEAN"}[kind]
    return F.when(is_kind, F.try_variant_get(v, f"$.{path}", kind))


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "array<variant>")


def _texts(v: Column, names: dict[str, str]) -> Column:
    return F.struct(*[strict(v, theirs, "string").alias(ours) for ours, theirs in names.items()])


def _block(v: Column, path: str, names: dict[str, str]) -> Column:
    at = F.try_variant_get(v, f"$.{path}", "variant")
    return F.when(F.startswith(F.schema_of_variant(at), F.lit("OBJECT")), _texts(at, names))


def item_columns(v: Column) -> list[Column]:
    """Typed columns of an item held as VARIANT; arrays that are none count as missing."""
    login = F.try_variant_get(v, "$.login", "variant")
    uris = F.transform(_list(login, "uris"), lambda u: F.struct(strict(u, "uri", "string").alias("uri"), strict(u, "match", "bigint").alias("uri_match")))
    creds = F.transform(_list(login, "fido2Credentials"), lambda c: F.struct(strict(c, "credentialId", "string").alias("credential_id"), strict(c, "rpId", "string").alias("rp_id"), strict(c, "userName", "string").alias("user_name"), strict(c, "counter", "string").alias("counter"), strict(c, "creationDate", "string").alias("creation_date")))
    is_login = F.startswith(F.schema_of_variant(login), F.lit("OBJECT"))
    fields = F.transform(_list(v, "fields"), lambda f: F.struct(strict(f, "name", "string").alias("name"), strict(f, "value", "string").alias("field_value"), strict(f, "type", "bigint").alias("field_type"), strict(f, "linkedId", "bigint").alias("linked_id")))
    return [
        *[strict(v, path, kind).alias(ours) for ours, (path, kind) in ITEM_FIELDS.items()],
        F.transform(_list(v, "collectionIds"), lambda c: strict(F.to_variant_object(F.struct(c.alias("c"))), "c", "string")).alias("collection_ids"),
        fields.alias("custom_fields"),
        F.transform(_list(v, "passwordHistory"), lambda h: F.struct(strict(h, "password", "string").alias("password"), strict(h, "lastUsedDate", "string").alias("last_used_date"))).alias("password_history"),
        F.when(is_login, F.struct(*[strict(login, p, "string").alias(o) for o, p in (("username", "username"), ("password", "password"), ("totp", "totp"), ("password_revision_date", "passwordRevisionDate"))], uris.alias("uris"), creds.alias("fido2_credentials"))).alias("login"),
        F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.secureNote", "variant")), F.lit("OBJECT")), F.struct(strict(v, "secureNote.type", "bigint").alias("note_type"))).alias("secure_note"),
        _block(v, "card", _CARD).alias("card"), _block(v, "identity", _IDENT).alias("ident"), _block(v, "sshKey", _SSH).alias("ssh_key"),
    ]


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, folders) of an export document. Items keep their position and raw VARIANT, so unknown
    fields are not lost. Fails if the text is no JSON, no object, or has no array of items; missing
    folders are none. The document is parsed once, into tables in the shared folder."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    kind = F.schema_of_variant("doc")
    items = F.variant_get("doc", "$.items", "variant")
    checked = doc.withColumn("doc", F.when(~F.startswith(kind, F.lit("OBJECT")), F.raise_error(F.lit("the export is not an object"))).when(items.isNull(), F.raise_error(F.lit("the export has no items"))).when(~F.startswith(F.schema_of_variant(items), F.lit("ARRAY")), F.raise_error(F.lit("items is not an array"))).otherwise(F.col("doc")))
    rows = checked.select(F.posexplode(F.variant_get("doc", "$.items", "array<variant>")).alias("pos", "raw"))
    folders = checked.select(F.posexplode(F.try_variant_get("doc", "$.folders", "array<variant>")).alias("pos", "f"))
    pos = F.col("pos").cast("bigint").alias("pos")
    return cut(rows.select(pos, "raw", *item_columns(F.col("raw")))), cut(folders.select(pos, strict(F.col("f"), "id", "string").alias("id"), strict(F.col("f"), "name", "string").alias("name")))


def item_json(items: DataFrame) -> DataFrame:
    """(pos, item): items as export JSON text with sorted keys per level; null fields are written."""
    pairs = lambda names, at: F.struct(*[F.col(f"{at}.{o}").alias(t) for o, t in sorted(names.items(), key=lambda x: x[1])])
    login = F.struct(F.transform("login.fido2_credentials", lambda c: F.struct(c.counter.alias("counter"), c.creation_date.alias("creationDate"), c.credential_id.alias("credentialId"), c.rp_id.alias("rpId"), c.user_name.alias("userName"))).alias("fido2Credentials"), F.col("login.password").alias("password"), F.col("login.password_revision_date").alias("passwordRevisionDate"), F.col("login.totp").alias("totp"), F.transform("login.uris", lambda u: F.struct(u.uri_match.alias("match"), u.uri.alias("uri"))).alias("uris"), F.col("login.username").alias("username"))
    cols = {t: F.col(o) for o, (t, _) in ITEM_FIELDS.items()} | {
        "collectionIds": F.col("collection_ids"), "fields": F.transform("custom_fields", lambda f: F.struct(f.linked_id.alias("linkedId"), f["name"].alias("name"), f.field_type.alias("type"), f.field_value.alias("value"))),
        "passwordHistory": F.transform("password_history", lambda h: F.struct(h.last_used_date.alias("lastUsedDate"), h.password.alias("password"))), "login": F.when(F.col("login").isNotNull(), login), "secureNote": F.when(F.col("secure_note").isNotNull(), F.struct(F.col("secure_note.note_type").alias("type"))),
        "card": F.when(F.col("card").isNotNull(), pairs(_CARD, "card")), "identity": F.when(F.col("ident").isNotNull(), pairs(_IDENT, "ident")), "sshKey": F.when(F.col("ssh_key").isNotNull(), pairs(_SSH, "ssh_key")),
    }
    return items.select("pos", F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)]), {"ignoreNullFields": "false"}).alias("item"))


def write_split(items: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Living and trashed items to two tables under folder. errorifexists never overwrites; with
    overwrite an empty trash leaves an empty table, so no stale one stays."""
    from ..operators.dedup import living, trashed

    living(items).write.mode(mode).parquet(f"{folder}/living")
    trashed(items).write.mode(mode).parquet(f"{folder}/trashed")


def write_document(text: str, path: str, clobber: bool = False) -> None:
    """One small file, whole or not at all, readable by its owner only. Without clobber an existing
    file is an error."""
    target = Path(path)
    fd, tmp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            os.fchmod(f.fileno(), 0o600)
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if clobber:
            os.replace(tmp, target)
        else:
            os.link(tmp, target)
            os.unlink(tmp)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise
    folder = os.open(target.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def distinct_paths(*paths: str) -> None:
    """Refuse two paths that name one file."""
    real = [os.path.join(os.path.realpath(os.path.dirname(p) or "."), os.path.basename(p)) if not os.path.exists(p) else os.path.realpath(p) for p in paths]
    if len(set(real)) < len(real):
        raise ValueError(f"two paths name one file: {', '.join(paths)}")


def outside_repository(path: str, ignored: tuple[str, ...] = (".redacted.json",), safe_dirs: tuple[str, ...] = ("vault",)) -> None:
    """Refuse to write into a version-controlled folder, but for known ignored shapes."""
    p = Path(path).resolve()
    if p.name.endswith(ignored) or any(d in p.parts for d in safe_dirs):
        return
    if any((parent / ".git").exists() for parent in p.parents):
        raise ValueError(f"{path} lies in a repository")


def latest_file(names: DataFrame, prefixes: tuple[str, ...], denied_endings: tuple[str, ...] = (), denied_parts: tuple[str, ...] = (), column: str = "path") -> DataFrame:
    """One row with the lexically last name that begins with a prefix and is no generated file."""
    base = F.substring_index(column, "/", -1)
    ok = F.lit(False)
    for x in prefixes:
        ok = ok | F.startswith(base, F.lit(x))
    for x in denied_endings:
        ok = ok & ~F.endswith(base, F.lit(x))
    for x in denied_parts:
        ok = ok & ~F.contains(base, F.lit(x))
    return names.where(ok).agg(F.max(column).alias(column))


def latest_text(files: DataFrame, exact: str, prefix: str, ending: str, path: str = "path", text: str = "text") -> DataFrame:
    """The file named exact if it is not blank, else the lexically last non-blank prefix*ending."""
    from ..functions.text import is_blank

    base = F.substring_index(path, "/", -1)
    ok = (base == exact) | (F.startswith(base, F.lit(prefix)) & F.endswith(base, F.lit(ending)))
    return files.where(ok & ~is_blank(F.col(text))).agg(F.max_by(path, F.struct(base == exact, F.col(path))).alias(path), F.max_by(text, F.struct(base == exact, F.col(path))).alias(text))


def media_files(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> DataFrame:
    """(path, length) of all files under folder with one of the endings, sorted, each once. Contents are
    not read."""
    pattern = "|".join(map(re.escape, endings))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.where(F.lower("path").rlike(rf"\.({pattern})\z")).distinct().orderBy("path")


def not_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def snapshot_counts(bodies: DataFrame, key: str = "body_id", body: str = "body") -> DataFrame:
    """(key, n_ciphers, n_folders, has_key, n_bytes) of raw sync bodies, without opening their items.
    Keys of the top level count in any case; what is no array counts 0, null if it is no JSON."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in names])

    size = lambda *names: F.coalesce(F.json_array_length(first(*names)), F.lit(0)).cast("bigint")
    profile_key = F.coalesce(F.get_json_object(body, "$.profile.key"), F.get_json_object(body, "$.Profile.Key"))
    return bodies.select(key, size("ciphers", "Ciphers").alias("n_ciphers"), size("folders", "Folders").alias("n_folders"), (text_or_empty(profile_key) != "").alias("has_key"), F.octet_length(body).cast("bigint").alias("n_bytes"))


def valid_snapshot_path(path: Column, prefix: str, endings: str = r"(?:-with-trash)?") -> Column:
    """Inside a vault folder, without "..", named prefix + 14 or 17 digits + .json."""
    return path.rlike(r"(?:\A|/)vault/") & ~path.rlike(r"(?:\A|/)\.\.(?:/|\z)") & path.rlike(rf"(?:\A|/){re.escape(prefix)}(?:\d{{14}}|\d{{17}}){endings}\.json\z")
