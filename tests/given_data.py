"""Where the given tables lie; a module of its own, since every test folder may have a conftest."""

SMALL = "/root/testdata/sf0.001"
