"""python tests/llm/compare_llm.py [substring ...]: the queries of this folder against their SQL, with times."""
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), os.path.dirname(HERE)]

if __name__ == "__main__":
    import __spark_entry__
    from compare import compare, duck

    from hearthmark.session import build_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = build_session("compare-llm", "local[8]"), duck(folder)
    for name, fn in __spark_entry__.queries().items():
        if (name.startswith("op") and name[2:3].isdigit() or name == "pipeline") and (not sys.argv[1:] or any(x in name for x in sys.argv[1:])):
            t = time.time()
            ok, msg = compare(spark, con, folder, name, fn, __spark_entry__.oracle_sql().get(name))
            print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, f"{time.time() - t:.1f}s", msg, flush=True)
