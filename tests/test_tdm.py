from sitestance.operators import tdm

TWO = """[
  {"tdm-policy": "https://rights.example.org/terms", "location": "/", "tdm-reservation": 1},
  {"tdm-reservation": 0, "location": "/press/2023"}
]"""
# Inputs and the results they must have.
CASES = {
    1: TWO, 2: '{"location":"/"}', 3: '[{"location":"/","tdm-reservation":1},{"location":"/b"}]', 4: "[]",
    5: '[{"location":"/","tdm-reservation":"1"},{"location":"/","tdm-reservation":1.9},'
       '{"location":"/","tdm-reservation":"x"},{"location":"/","tdm-reservation":true}]',
    6: '[{"location":"/","tdm-reservation":1,"tdm-policy":null}]', 7: "[5]", 8: "[{", 9: "[]", 10: "  ",
    11: "null", 12: '[{"location":"/","tdm-reservation":0,"tdm-reservation":1}]',
}


def test_groups(spark):
    rows = [(k, "text/html" if k == 9 else "application/json", v.encode()) for k, v in CASES.items()]
    docs = spark.createDataFrame(rows, "doc_id long, content_type string, content binary")
    r = {x["doc_id"]: x for x in tdm.profile(docs).collect()}
    assert r[1]["num_groups"] == 2
    assert r[1]["groups_text"] == (
        "[Group{location='/', tdmReservation=1, tdmPolicy='https://rights.example.org/terms'}, "
        "Group{location='/press/2023', tdmReservation=0}]"
    )
    for k in (2, 10, 11):
        assert r[k]["error"] == tdm.NOT_AN_ARRAY, k
    for k in (3, 7):
        assert r[k]["error"] == tdm.NOT_PARSED and r[k]["num_groups"] is None
    assert r[4]["num_groups"] == 0 and r[4]["groups_text"] == "[]"
    assert [g["tdm_reservation"] for g in r[5]["groups"]] == [1, 1, 0, 1]
    assert r[6]["groups"][0]["tdm_policy"] == "null"
    assert r[8]["error"] == tdm.NOT_JSON
    assert r[9]["error"] is None and r[9]["num_groups"] is None and r[9]["content_type"] == "text/html"
    assert r[12]["groups"][0]["tdm_reservation"] == 1
