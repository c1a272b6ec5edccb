"""License notices wrapped over lines."""

import pytest

from stridelog.llm import licenses


@pytest.mark.parametrize("between", ["\n", "\r\n * ", "\n# ", "\t", "  "])
def test_wrapped_license_notices(spark, between):
    notices = {
        "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "redistribution and use in source and binary forms, with or without modification": "bsd",
        "general public license": "gpl", "apache license": "apache", "mozilla public license": "mpl",
    }
    rows = [(i, t.replace(" ", between)) for i, t in enumerate(notices)]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "detections.label").collect()
    assert {r.doc_id: set(r.label) for r in found} == {i: {x} for i, x in enumerate(notices.values())}
