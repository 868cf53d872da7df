"""Small item tables for tests."""

from pyspark.sql import types as T

SCHEMA = """pos bigint, id string, organization_id string, folder_id string, cipher_type bigint, reprompt bigint, favorite boolean, name string, notes string, creation_date string, revision_date string,
deleted_date string, archived_date string, collection_ids array<string>, custom_fields array<struct<name:string,field_value:string,field_type:bigint,linked_id:bigint>>, password_history array<struct<password:string,last_used_date:string>>,
login struct<username:string,password:string,totp:string,password_revision_date:string,uris:array<struct<uri:string,uri_match:bigint>>,fido2_credentials:array<struct<credential_id:string,rp_id:string,user_name:string,counter:string,creation_date:string>>>,
secure_note struct<note_type:bigint>, card struct<cardholder_name:string,brand:string,card_number:string,exp_month:string,exp_year:string,card_code:string>,
ident struct<title:string,first_name:string,last_name:string>, ssh_key struct<private_key:string,public_key:string,key_fingerprint:string>"""


def table(spark, *dicts):
    """An item table of partial dicts; pos counts from 0, dates have defaults."""
    fields = T._parse_datatype_string(SCHEMA) if isinstance(SCHEMA, str) else SCHEMA
    names = [f.name for f in fields]
    out = []
    for i, d in enumerate(dicts):
        full = dict.fromkeys(names) | {"pos": i, "id": f"id-{i}", "cipher_type": 1, "reprompt": 0, "name": f"Name {i}", "creation_date": "2020-01-01T00:00:00Z", "revision_date": "2021-01-01T00:00:00Z"} | d
        out.append(tuple(full[n] for n in names))
    return spark.createDataFrame(out, fields)


def login(user="u", password="p", uris=(), totp=None, creds=None):
    return {"username": user, "password": password, "totp": totp, "password_revision_date": None, "uris": [{"uri": u, "uri_match": m} for u, m in uris], "fido2_credentials": creds}
