from stratograph.api import Engine
from stratograph.sources.workspace import Workspace
from tests.test_workspace import LAYERED, put


def test_every_query_answers(spark, tmp_path):
    put(tmp_path / "w", LAYERED)
    e = Engine(spark, workspace=Workspace(spark, str(tmp_path / "w"), str(tmp_path / "s")))
    assert e.get_index_status()["files"] == 3 and e.sync_index()["cached"] == 3
    assert e.zoom_overview()["domains"].count() == 3
    module = e.zoom_module("src/service/user_service.py")
    assert module["file"].first()["functions"] == 1 and module["links"].count() == 2 and e.zoom_module("none")["file"].count() == 0
    assert e.zoom_symbol("serve")["callers"].count() == 1 and e.zoom_search("serve").count() >= 1 and e.query_graph(level="L3").count() == 3
    told = e.check_layer_violation("src/repository/user_repository.py")
    assert told["violations"].count() == 1 and told["cycles"].count() == 1 and told["coupling"].count() == 1
    assert e.estimate_blast_radius("load")["summary"].first()["total_affected_symbols"] == 2
    assert e.trace_call_path("handle").count() == 2 and e.trace_call_path("handle", "load").first()["hops"] == 2
    diff = "+++ b/src/repository/user_repository.py\n@@ -4 +4 @@\n"
    assert e.detect_changes(raw_diff=diff)["changed"].first()["name"] == "load" and e.detect_changes(raw_diff=diff, scope="tests")["affected"].count() == 0
    assert e.list_routes().count() == 0 and e.detect_communities()["score"].count() == 1
    e.manage_adr("create", title="Keep it", today="2025-01-01")
    assert e.manage_adr("list").count() == 1 and e.manage_adr("update", "1", status="rejected").first()["status"] == "rejected" and e.manage_adr("delete", "1").count() == 0
