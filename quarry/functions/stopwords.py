"""Stop words. An English list; every analyzer takes another if given one."""

ENGLISH = (
    "i me my we you he she it they them this that these those am is are was were be been being have has had having do does did "
    "a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
