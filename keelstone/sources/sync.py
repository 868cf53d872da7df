"""Encrypted sync bodies to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.urls import bind
from .vault import _CARD, _IDENT, _SSH

_strings = lambda names: "struct<" + ",".join(f"{n}:string" for n in names) + ">"
_CIPHER = (
    "struct<id:string,organizationId:string,folderId:string,type:bigint,reprompt:bigint,favorite:boolean,key:string,name:string,notes:string,creationDate:string,revisionDate:string,deletedDate:string,archivedDate:string,collectionIds:array<string>,"
    "fields:array<struct<name:string,value:string,type:bigint,linkedId:bigint>>,passwordHistory:array<struct<password:string,lastUsedDate:string>>,login:struct<username:string,password:string,totp:string,passwordRevisionDate:string,uris:array<struct<uri:string,match:bigint>>,"
    "fido2Credentials:array<struct<credentialId:string,rpId:string,userName:string,counter:string,creationDate:string>>>,secureNote:struct<type:bigint>," + f"card:{_strings(_CARD.values())},identity:{_strings(_IDENT.values())},sshKey:{_strings(_SSH.values())}>"
)
BODY = f"profile struct<key:string>, folders array<struct<id:string,name:string>>, ciphers array<{_CIPHER}>"


def _split(raw: Column) -> Column:
    """Ready keys of 64 clear bytes."""
    return bind(raw, lambda b: F.when(F.octet_length(b) == 64, crypto.keys(F.substring(b, 1, 32), F.substring(b, 33, 32))))


def _opened(bodies: DataFrame, key: str, body: str, master: tuple[bytes, bytes]) -> DataFrame:
    parsed = bodies.select(F.col(key), F.from_json(body, BODY).alias("b"))
    return parsed.withColumn("user_key", _split(crypto.decrypted_bytes(F.col("b.profile.key"), crypto.constant_key(master))))


def decrypted_items(bodies: DataFrame, master: tuple[bytes, bytes], key: str = "body_id", body: str = "body") -> DataFrame:
    """Items of encrypted bodies in the item schema, with (key, pos). master is what stretch() gives. An
    item with a key of its own is read with that, others with the user key of their body. Items of
    organizations need keys that are not there and are left out; count them with snapshot facts. A
    text whose MAC does not hold is null, and so are all texts of a body without a readable key."""
    rows = _opened(bodies, key, body, master).select(key, "user_key", F.posexplode("b.ciphers").alias("pos", "c")).where("c is not null and c.organizationId is null")
    rows = rows.withColumn("k", F.when(F.col("c.key").isNull(), F.col("user_key")).otherwise(_split(crypto.decrypted_bytes(F.col("c.key"), F.col("user_key")))))
    k = F.col("k")
    clear = lambda c: F.when(c == "", c).otherwise(crypto.decrypted(c, k))
    block = lambda at, names: F.when(F.col(at).isNotNull(), F.struct(*[clear(F.col(f"{at}.{theirs}")).alias(ours) for ours, theirs in names.items()]))
    creds = F.transform("c.login.fido2Credentials", lambda x: F.struct(clear(x.credentialId).alias("credential_id"), clear(x.rpId).alias("rp_id"), clear(x.userName).alias("user_name"), clear(x.counter).alias("counter"), x.creationDate.alias("creation_date")))
    login = F.struct(*[clear(F.col(f"c.login.{n}")).alias(n) for n in ("username", "password", "totp")], F.col("c.login.passwordRevisionDate").alias("password_revision_date"), F.transform("c.login.uris", lambda u: F.struct(clear(u.uri).alias("uri"), u["match"].alias("uri_match"))).alias("uris"), creds.alias("fido2_credentials"))
    return rows.select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("c.id").alias("id"), F.col("c.organizationId").alias("organization_id"), F.col("c.folderId").alias("folder_id"), F.col("c.type").alias("cipher_type"), F.col("c.reprompt").alias("reprompt"), F.col("c.favorite").alias("favorite"), clear(F.col("c.name")).alias("name"),
        clear(F.col("c.notes")).alias("notes"), F.col("c.creationDate").alias("creation_date"), F.col("c.revisionDate").alias("revision_date"), F.col("c.deletedDate").alias("deleted_date"), F.col("c.archivedDate").alias("archived_date"), F.col("c.collectionIds").alias("collection_ids"),
        F.transform("c.fields", lambda f: F.struct(clear(f["name"]).alias("name"), clear(f["value"]).alias("field_value"), f["type"].alias("field_type"), f.linkedId.alias("linked_id"))).alias("custom_fields"), F.transform("c.passwordHistory", lambda h: F.struct(clear(h.password).alias("password"), h.lastUsedDate.alias("last_used_date"))).alias("password_history"),
        F.when(F.col("c.login").isNotNull(), login).alias("login"), F.when(F.col("c.secureNote").isNotNull(), F.struct(F.col("c.secureNote.type").alias("note_type"))).alias("secure_note"), block("c.card", _CARD).alias("card"), block("c.identity", _IDENT).alias("ident"), block("c.sshKey", _SSH).alias("ssh_key"),
    )


def decrypted_folders(bodies: DataFrame, master: tuple[bytes, bytes], key: str = "body_id", body: str = "body") -> DataFrame:
    rows = _opened(bodies, key, body, master).select(key, "user_key", F.posexplode("b.folders").alias("pos", "f")).where("f is not null")
    return rows.select(key, F.col("pos").cast("bigint").alias("pos"), F.col("f.id").alias("id"), crypto.decrypted(F.col("f.name"), F.col("user_key")).alias("name"))
