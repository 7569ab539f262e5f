"""How bound tables set up shuffles."""

from tessera.plans import binding

ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_tasks_of_a_shuffle_dont_grow_to_the_default_size(spark):
    spark.conf.unset(ADVISED)
    binding.view(spark, "/root/testdata/sf0.001", "region")
    assert spark.conf.get(ADVISED) == str(binding.JOINED_BYTES)
    spark.conf.set(ADVISED, "8m")  # one that a session has chosen stays
    binding.view(spark, "/root/testdata/sf0.001", "region")
    assert spark.conf.get(ADVISED) == "8m"
    spark.conf.unset(ADVISED)


def test_a_task_of_a_shuffle_takes_few_megabytes():
    """Rows of the graph take some 9 bytes shuffled and 200 in a hash table."""
    assert binding.JOINED_BYTES // 9 * 200 < 128 << 20


def test_lines_are_dealt_before_they_are_grouped(spark):
    """A task that reads lines holds no groups of them: nothing is summed up below the shuffle that deals them."""
    edges = binding.view(spark, "/root/testdata/sf0.001", "kg_edges").where("rel = 'SUPPLIED_BY'")
    plan = edges._jdf.queryExecution().executedPlan().toString()
    first, dealt = plan.rindex("avg(l_discount"), plan.index("Exchange hashpartitioning(l_partkey")
    assert first < dealt and plan.count("Exchange hashpartitioning(l_partkey") == 1
