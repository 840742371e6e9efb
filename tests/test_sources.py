import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import normalise as N

def now():
    return F.lit(dt.datetime(2026, 9, 8))


PAYLOADS = {
    "greenhouse": ({"jobs": [{"id": 7, "title": "Data Engineer", "updated_at": "2026-08-20T10:00:00Z", "location": {"name": "Paris, France"}, "absolute_url": "https://boards.example.com/7", "content": "&lt;p&gt;Hi&lt;/p&gt;", "departments": [{"name": "Data"}]}, {"id": 8, "title": None, "absolute_url": "https://boards.example.com/8"}]}, {"title": "Data Engineer", "company": "Acme Corp", "city": "Paris", "description": "Hi", "skills": ["Data"]}),
    "lever": ([{"id": "l1", "text": "Stage Data", "hostedUrl": "https://jobs.example.com/l1", "createdAt": 1787000000000, "categories": {"location": "Lyon", "commitment": "Full-time"}, "descriptionPlain": "x", "workplaceType": "remote"}], {"job_type": "internship", "remote_type": "remote"}),
    "ashby": ({"jobs": [{"id": "a", "title": "Dev", "jobUrl": "https://j.example.com/a", "isListed": True, "isRemote": True, "compensation": {"compensationTierSummary": "$100k - $120k"}}, {"id": "b", "title": "Dev", "jobUrl": "https://j.example.com/b", "isListed": False}]}, {"salary_min": 100000.0, "salary_max": 120000.0, "salary_currency": "USD"}),
    "workday": ({"total": 1, "jobPostings": [{"title": "Analyst", "externalPath": "/job/1", "locationsText": "2 Locations", "postedOn": "Posted 5 Days Ago", "bulletFields": ["x", "R-12"]}]}, {"source_job_id": "R-12", "location": None}),
    "oracle_hcm": ({"items": [{"TotalJobsCount": 1, "requisitionList": [{"Id": "9", "Title": "Chef", "PostedDate": "2026-08-01", "PrimaryLocation": "Rome, Italy", "PrimaryLocationCountry": "IT"}]}]}, {"country": "IT", "city": "Rome"}),
    "adzuna": ({"count": 1, "results": [{"id": "3", "redirect_url": "https://z.example.com/3", "title": "Cook", "created": "2026-08-01T00:00:00Z", "company": {"display_name": "Co"}, "location": {"display_name": "London", "area": ["UK"]}}]}, {"country": "UK"}),
    "arbeitnow": ({"data": [{"slug": "s", "company_name": "Co", "title": "Dev", "description": "<b>x</b>", "remote": True, "url": "https://a.example.com/s", "tags": ["a", "A", "b"], "job_types": ["full"], "location": "Berlin", "created_at": 1787000000}]}, {"skills": ["a", "b"], "remote_type": "remote"}),
    "remotive": ({"jobs": [{"id": 1, "url": "https://r.example.com/1", "title": "Dev", "company_name": "Co", "salary": "$50k", "description": "d", "publication_date": "2026-08-01T00:00:00"}]}, {"salary_period": "year", "salary_min": 50000.0}),
    "jobicy": ({"jobs": [{"id": 1, "url": "https://j.example.com/1", "jobTitle": "Dev", "companyName": "Co", "annualSalaryMin": "0", "annualSalaryMax": "90000", "jobLevel": "Senior"}]}, {"salary_min": None, "salary_max": 90000.0, "experience_level": "senior"}),
    "remoteok": ([{"legal": "notice"}, {"id": "1", "url": "https://r.example.com/1", "position": "Dev", "company": "Co", "salary_min": 10000.0}], {"salary_currency": "USD"}),
    "hackernews": ({"children": [{"id": 1, "author": "x", "created_at": "2026-08-01T00:00:00Z", "text": "Acme | Backend Engineer | Berlin<p>We build things"}, {"id": 2, "text": "short"}]}, {"company": "Acme", "title": "Backend Engineer", "location": "Berlin"}),
    "smartrecruiters": ({"content": [{"id": "5", "name": "Dev", "company": {"name": "Co"}, "location": {"city": "Nice", "country": "fr"}}]}, {"location": "Nice, fr"}),
    "phenom": ({"refineSearch": {"totalHits": 1, "data": {"jobs": [{"jobId": "p", "title": "Dev", "applyUrl": "https://p.example.com/j/p/apply", "category": "IT", "ml_skills": ["x"]}]}}}, {"source_url": "https://p.example.com/j/p", "skills": ["IT", "x"]}),
    "rippling": ([{"id": 1, "uuid": "u", "name": "Dev", "url": "https://r.example.com/u", "workLocation": {"label": "Oslo"}}], {"location": "Oslo"}),
    "himalayas": ({"jobs": [{"guid": "g", "title": "Dev", "companyName": "Co", "applicationLink": "https://h.example.com/g", "seniority": ["Junior"], "locationRestrictions": ["FR", "DE"]}]}, {"experience_level": "junior"}),
}


@pytest.mark.parametrize("source", sorted(PAYLOADS))
def test_projection(spark, tmp_path, source):
    payload, want = PAYLOADS[source]
    path = tmp_path / "p.json"
    path.write_text(json.dumps(payload))
    board = "acme-corp.example.com" if source in ("workday", "oracle_hcm", "phenom") else "acme-corp"
    rows = N.to_offers(N.read_payloads(spark, source, str(path), board), source, now()).collect()
    assert len(rows) == 1
    got = rows[0].asDict()
    assert {k: got[k] for k in want} == want


def test_rss_and_weworkremotely(spark, tmp_path):
    (tmp_path / "a.rss").write_text("<rss><channel><item><title>Co: Dev</title><link>https://w.example.com/jobs/dev-1</link><description>&lt;p&gt;x&lt;/p&gt;</description><pubDate>Thu, 20 Aug 2026 10:00:00 +0000</pubDate></item></channel></rss>")
    (tmp_path / "b.rss").write_text("broken")
    row = N.to_offers(N.read_rss(spark, str(tmp_path)), "weworkremotely", now()).collect()
    assert [(r.company, r.title, r.source_job_id, str(r.posted_at)) for r in row] == [("Co", "Dev", "dev-1", "2026-08-20 10:00:00")]


def test_json_ld(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "A"}, {"@type": "Thing"}]}</script><script type="application/ld+json">[{"@type":"JobPosting","title":"B"}]</script><script type="application/ld+json">{broken</script>'
    df = N.json_ld(spark.createDataFrame([(1, html)], "id int, html string"))
    assert sorted(r.t for r in df.select(F.get_json_object("node", "$.title").alias("t")).collect()) == ["A", "B"]


def test_within_source_and_tokens(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "X", "second"), (1, "a", "x", "first")], "seq long, source string, source_job_id string, title string")
    assert [r.title for r in N.within_source(df).collect()] == ["first"]
    (tmp_path / "t.txt").write_text("acme # ok\n# no\nbad token\nACME\n")
    assert [r.token for r in N.board_tokens(spark.read.text(str(tmp_path / "t.txt"))).collect()] == ["ACME"]
