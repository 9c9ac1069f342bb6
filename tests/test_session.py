from resgov.session import SQL_SETTINGS, STATIC_SETTINGS, configure


def test_runtime_settings_are_modifiable(spark):
    # configure() runs on sessions built elsewhere (driver, notebook, cluster):
    # it may only touch settings a running session accepts
    for key in SQL_SETTINGS:
        assert spark.conf.isModifiable(key), key
    for key in STATIC_SETTINGS:
        assert not spark.conf.isModifiable(key), key
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    configure(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
