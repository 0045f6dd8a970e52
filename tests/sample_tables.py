"""Where the driver's sample tables are."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
