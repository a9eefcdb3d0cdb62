"""tempora: spatio-temporal map analytics and corpus preparation as ordinary PySpark jobs."""
