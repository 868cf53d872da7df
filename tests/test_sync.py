import base64
import hashlib
import hmac
import json

from conftest import rows
from pyspark.sql import functions as F

from keelstone.functions import crypto
from keelstone.operators import dedup
from keelstone.sources import sync


def test_encrypted_bodies(spark):
    master = crypto.stretch(hashlib.sha256(b"m").digest())
    user, own = bytes(range(64)), bytes(range(64, 128))
    made = {}

    def sealed(clear: bytes, key: bytes) -> str:
        iv = hashlib.md5(clear + key).digest()
        if (clear, key) not in made:
            made[clear, key] = bytes(spark.range(1).select(F.aes_encrypt(F.lit(clear), F.lit(key[:32]), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)).alias("b")).first().b)[16:]
        data = made[clear, key]
        b64 = lambda b: base64.b64encode(b).decode()
        return f"2.{b64(iv)}|{b64(data)}|{b64(hmac.new(key[32:], iv + data, hashlib.sha256).digest())}"

    s = lambda t, k=user: sealed(t.encode(), k)
    login = {"username": s("u"), "password": s("p"), "uris": [{"uri": s("https://a"), "match": 1}]}
    body = {"profile": {"key": sealed(user, master[0] + master[1])}, "folders": [{"id": "f", "name": s("Main")}], "ciphers": [
        {"id": "1", "type": 1, "name": s("A"), "login": login, "fields": [{"name": s("n"), "value": "", "type": 0}]}, {"id": "2", "type": 1, "key": sealed(own, user), "name": s("A", own), "login": {"username": s("u", own), "password": s("p", own)}},
        {"id": "3", "organizationId": "o", "type": 1, "name": "2.x"}, {"id": "4", "type": 2, "name": s("A", own), "notes": "0.plain", "secureNote": {"type": 0}}, None,
    ]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps(body | {"profile": {"key": "2.bad"}})), (3, None), (4, "{")], "body_id bigint, body string")
    items = sync.decrypted_items(df, master)
    assert rows(items.where("body_id = 1"), "id", "name", "notes") == [("1", "A", None), ("2", "A", None), ("4", None, None)]
    one = items.where("body_id = 1 and id = '1'").first()
    assert (one.login.username, one.login.uris[0].uri, one.login.uris[0].uri_match, one.custom_fields[0].name, one.custom_fields[0].field_value) == ("u", "https://a", 1, "n", "")
    assert {r[0] for r in rows(items.where("body_id = 2"), "name")} == {None}
    assert rows(sync.decrypted_folders(df, master)) == [(1, 0, "f", "Main"), (2, 0, "f", None)]
    assert dedup.groups(dedup.with_groups(items.where("body_id = 1"))).count() == 1
